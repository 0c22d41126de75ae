"""Plain text files as documents."""

from pyspark.sql import functions as F

from scriptorium.session import by_bytes, planned_bytes

LINE_END = r"\r\n?"


def text_file_scan(spark, path, glob="*.txt", max_bytes=None):
    """``(path, idx, text)``: one file is one document, one line one paragraph.

    All files are read; limits are the upload gate's. With ``max_bytes`` larger ones are not
    read, and give one row whose ``idx`` and ``text`` are null. The line feed that ends the last line
    does not start another paragraph.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option(
        "recursiveFileLookup", True
    ).load(path)
    name = F.col("_metadata.file_path").alias("path")
    if max_bytes is None:
        return _lines(_texts(found))
    none = (F.lit(None).cast("long").alias("idx"), F.lit(None).cast("string").alias("text"))
    too_large = found.where(F.col("length") > max_bytes)
    return _lines(_texts(found.where(F.col("length") <= max_bytes))).unionByName(too_large.select(name, *none))


def _texts(found):
    """``(path, text)`` of files; the bytes are taken as UTF-8."""
    texts = found.select(F.col("_metadata.file_path").alias("path"), F.col("content").cast("string").alias("text"))
    return by_bytes(texts, planned_bytes(found))


def _lines(files):
    unified = F.regexp_replace("text", LINE_END, "\n")
    lines = F.split(F.regexp_replace(unified, r"\n\z", ""), "\n")
    return files.select("path", F.posexplode(lines).alias("pos", "text")).select(
        "path", F.col("pos").cast("long").alias("idx"), "text"
    )
