"""Upload gate and storage names."""

from pyspark.sql import functions as F

from scriptorium.functions.names import (
    ALLOWED_EXTENSIONS,
    MAX_UPLOAD_BYTES,
    extension,
    storage_key,
)


def upload_gate(files, max_bytes=MAX_UPLOAD_BYTES):
    """Add ``ext``, ``accepted`` and ``reject_reason``; rejects stay in the table.

    The extension is judged before the size, and a file of exactly the limit passes.
    """
    ext = extension(F.lower("name"))
    reason = F.when(~F.col("ext").isin(ALLOWED_EXTENSIONS), "file_type").when(
        F.col("size_bytes") > max_bytes, "file_size"
    )
    return (
        files.withColumn("ext", F.coalesce(ext, F.lit("")))
        .withColumn("reject_reason", F.coalesce(reason, F.lit("")))
        .withColumn("accepted", F.col("reject_reason") == "")
    )


def accepted_uploads(files, max_bytes=MAX_UPLOAD_BYTES):
    gated = upload_gate(files, max_bytes).where("accepted")
    return gated.withColumn("file_type", F.ltrim(F.col("ext"), F.lit("."))).drop(
        "ext", "accepted", "reject_reason"
    )


def storage_keys(files):
    return files.withColumn("storage_path", storage_key(F.col("doc_id"), F.col("name")))
