"""Versioned snapshots and text export. Nothing here overwrites an input."""

from pyspark.sql import functions as F

from scriptorium.sources.named_files import write_named_files


def snapshot_write(df, path, version, partition_by="file_type"):
    """Write ``df`` as a new version below ``path``; an existing version is an error.

    The rebalance hint evens out file sizes, splitting a partition value that holds
    most rows.
    """
    target = f"{path}/version={version}"
    df.hint("rebalance", partition_by).write.mode("errorifexists").partitionBy(
        partition_by
    ).parquet(target)
    return target


def read_snapshot(spark, path, version, schema):
    return spark.read.schema(schema).parquet(f"{path}/version={version}")


def export_text(docs, catalog, path):
    """Write documents ``(doc_id, text)`` as text per file type, documents in order.

    Each line is document, line number and text, parted by tabs, so every line tells whose
    it is. Documents outside the catalog go to ``other``. The export is made of lines before it
    is dealt out, so a long document may lie in several files.
    """
    typed = docs.join(catalog.select("doc_id", "file_type"), "doc_id", "left").select(
        F.coalesce("file_type", F.lit("other")).alias("file_type"),
        "doc_id",
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"),
    )
    order = ["file_type", "doc_id", "line_no"]
    ordered = typed.repartitionByRange(*order).sortWithinPartitions(*order)
    line = F.concat_ws("\t", "doc_id", "line_no", "line")
    ordered.select("file_type", line.alias("value")).write.mode("errorifexists").partitionBy(
        "file_type"
    ).text(path, lineSep="\n")
    return path


def read_export(spark, path):
    """``(doc_id, file_type, line_no, line)`` of an export."""
    rows = spark.read.schema("value string, file_type string").text(path, lineSep="\n")
    parts = F.split("value", "\t", 3)
    return rows.select(
        parts[0].cast("long").alias("doc_id"), "file_type",
        parts[1].cast("long").alias("line_no"), parts[2].alias("line"),
    )


def export_text_files(docs, path):
    """Write each document ``(doc_id, text)`` as a file ``<doc_id>.txt``, in one folder per task."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name")
    content = F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary").alias("content")
    return write_named_files(docs.select(name, content), path)
