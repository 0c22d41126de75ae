"""File names: extension, upload checks, storage keys."""

from pyspark.sql import functions as F

# What an upload may be.
ALLOWED_EXTENSIONS = [".pdf", ".docx"]
MAX_UPLOAD_BYTES = 10 * 1024 * 1024

# The last dot and what follows, unless only dots stand before it in the base name.
EXTENSION = r"[^./][^/]*?(\.[^./]*)\z"


def extension(name):
    """Extension with its dot, case kept; empty for a dotfile or a name without a dot."""
    return F.regexp_extract(name, EXTENSION, 1)


def storage_key(doc_id, name):
    """Stored file name; the same on every retry, distinct per document and name."""
    digest = F.sha2(F.concat_ws("|", doc_id.cast("string"), name), 256)
    return F.concat(digest, extension(name))
