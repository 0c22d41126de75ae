"""Image counts, image numbers and image replacement.

``images`` has one row per picture occurrence. ``pos`` is its place in the document, a
bigint unique there; occurrences that share ``part_id`` show the same stored image.
"""

from pyspark.sql import functions as F

from scriptorium.operators.ordinals import with_ordinal


def image_counts(images):
    """Per document: picture occurrences and distinct stored images.

    Grouping by part first spreads a document with very many pictures.
    """
    per_part = images.groupBy("doc_id", "part_id").agg(F.count("*").alias("n"))
    return per_part.groupBy("doc_id").agg(
        F.sum("n").alias("n_pictures"), F.count("*").alias("n_distinct")
    )


def _counted(docs, counts, column):
    counted = docs.select("doc_id").join(counts, "doc_id", "left")
    return counted.select(
        "doc_id", F.coalesce(column, F.lit(0).cast("long")).alias("images_count")
    )


def picture_counts(docs, images):
    """Occurrences per document, 0 for documents without pictures."""
    counts = images.groupBy("doc_id").agg(F.count("*").alias("n"))
    return _counted(docs, counts, "n")


def distinct_image_counts(docs, images):
    """Distinct stored images per document, 0 for documents without any."""
    return _counted(docs, image_counts(images), "n_distinct")


def picture_ordinals(images):
    """Number picture occurrences from 0 in document order."""
    return with_ordinal(images, ["doc_id"], "pos", "image_no")


def image_ordinals(images):
    """Number distinct images from 0 in order of first appearance."""
    first = images.groupBy("doc_id", "part_id").agg(F.min("pos").alias("pos"))
    return with_ordinal(first, ["doc_id"], "pos", "image_no", sized_by=images)


def replace_images(images, requests, by_occurrence):
    """Add ``new_image``, null where an occurrence keeps its image.

    ``requests(doc_id, seq, target_index, image)`` address an occurrence or a distinct
    image. Indexes out of range and empty images are ignored; the last request for a
    part wins, and all occurrences of the part change together.
    """
    usable = requests.where((F.col("target_index") >= 0) & (F.length("image") > 0))
    # one request per index before the join: only the last can matter
    last = usable.groupBy("doc_id", F.col("target_index").alias("image_no")).agg(
        F.max("seq").alias("seq"), F.max_by("image", "seq").alias("image")
    )
    numbered = picture_ordinals(images) if by_occurrence else image_ordinals(images)
    targets = (
        numbered.select("doc_id", "image_no", "part_id")
        .join(last, ["doc_id", "image_no"])
        .groupBy("doc_id", "part_id")
        .agg(F.max_by("image", "seq").alias("new_image"))
    )
    return images.join(targets, ["doc_id", "part_id"], "left")
