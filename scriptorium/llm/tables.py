"""Tables between steps: reading the inputs and cutting lineage in the shared folder."""

from pyspark.sql import functions as F

from scriptorium.session import shared_folder


def load(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df, label):
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    What follows neither recomputes it nor depends on the executors that made it.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(docs):
    """``(doc_id, text)`` of a documents table, whatever other columns it has."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def remainder(divisor):
    """crc32 of the id as text modulo ``divisor``: how the contracts split rows."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def labelled(labels, column, sample):
    """``(doc_id, label)`` of at most ``sample`` documents, chosen by hash of the id.

    Labels other than 0 and 1 are not used; of several labels of one document the larger one.
    The bound makes it safe to broadcast.
    """
    return (
        labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )


def fold():
    """Which quarter of the sample a row is in; quarter 0 calibrates what the others fit."""
    return F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4))
