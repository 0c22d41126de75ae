"""Uploads gated and added to the catalog exactly once per document.

Which documents are known is the state of a streaming aggregate in Spark's RocksDB state store. A
micro-batch reads its new files and the state of their documents, never the catalog, so what it reads
does not grow with the documents there are.
"""

from pyspark.sql import functions as F

from scriptorium.sources.uploads import accepted_uploads, storage_keys
from scriptorium.streaming.edits import run_available


def _first_per_document(uploads):
    """The upload of each ``doc_id`` that came first: in the earliest batch, then by ``seq``.

    The time of a batch is written down before it runs and is the same if it runs again. Only
    documents whose first upload is in the present batch go on.
    """
    now = F.current_timestamp()
    fields = [c for c in uploads.columns if c != "doc_id"]
    first = uploads.withColumn("_batch", now).groupBy("doc_id").agg(
        F.min(F.struct("_batch", "seq", *(c for c in fields if c != "seq"))).alias("row")
    )
    return first.where(F.col("row._batch") == now).select("doc_id", *(f"row.{c}" for c in fields))


def stream_uploads(uploads, path, checkpoint):
    """Append accepted uploads of documents not yet known to the catalog at ``path``.

    A batch writes its own folder ``batch=<id>``; running it again gives the same rows.
    """
    spark = uploads.sparkSession
    rows = storage_keys(accepted_uploads(uploads))
    empty = spark.createDataFrame([], rows.schema)
    empty.write.mode("ignore").parquet(f"{path}/batch=-1")
    ordered = rows.select("doc_id", "seq", *(c for c in rows.columns if c not in ("doc_id", "seq")))
    return run_available(_first_per_document(ordered), checkpoint, path, "update")


def read_uploads(spark, path, schema=None):
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).drop("batch")


def compact_uploads(spark, path, new_path):
    """Put all batches below ``path`` into one below ``new_path``, which must not exist."""
    read_uploads(spark, path).write.mode("errorifexists").parquet(f"{new_path}/batch=-1")
