"""Edits that arrive continuously as files, in any order and over any number of restarts.

The last edit per address is a streaming aggregate whose state lies in Spark's RocksDB state store,
below the checkpoint folder. A micro-batch reads the files that are new and the state of the
addresses they touch, and writes those addresses in update mode into its own folder
``batch=<id>``, in overwrite mode: a batch that is run again after a failure replaces its own output.
"""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.schemas import EDITS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream, checkpoint, path, mode):
    """Process what has arrived, each micro-batch into its own folder below ``path``.

    The state of keyed operators is kept on the disks of executors and in the checkpoint folder,
    not in their memory.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def write_batch(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write_batch)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def _written(spark, keys, path):
    fields = [EDITS[key] for key in (*keys, "seq", "text")]
    return spark.read.schema(StructType(fields)).parquet(path)


def _last_per_key(edits, keys):
    return edits.groupBy(*keys).agg(
        F.max("seq").alias("seq"), F.max_by("text", "seq").alias("text")
    )


def stream_latest_edits(edits, keys, path, checkpoint):
    """Append below ``path`` the last edit so far of every address that a micro-batch touches.

    An edit that comes late, behind one with a larger ``seq``, changes nothing.
    """
    addressed = edits.where(" AND ".join(f"{key} IS NOT NULL" for key in [*keys, "text"]))
    last = addressed.groupBy(*keys).agg(F.max(F.struct("seq", "text")).alias("last"))
    return run_available(last.select(*keys, "last.seq", "last.text"), checkpoint, path, "update")


def edits_in_state(spark, keys, checkpoint):
    """Current text per address, read from the state of the stream: no batch is read again."""
    state = spark.read.format("statestore").load(checkpoint)
    buffer = state.schema["value"].dataType.fieldNames()[0]
    return state.select(*(f"key.{key}" for key in keys), F.col(f"value.`{buffer}`.text").alias("new_text"))


def read_latest_edits(spark, keys, path):
    """Current text per address: the last edit over all batches, in whatever order they came."""
    latest = _last_per_key(_written(spark, keys, path), keys)
    return latest.select(*keys, F.col("text").alias("new_text"))


def compact_latest_edits(spark, keys, path, new_path):
    """Merge all batches below ``path`` into one below ``new_path``, which must not exist.

    A stream that goes on with its progress but writes to ``new_path`` adds to it.
    """
    merged = _last_per_key(_written(spark, keys, path), keys)
    merged.write.mode("errorifexists").parquet(f"{new_path}/batch=-1")
