"""Content edits addressed by paragraph index or by page and block."""

from pyspark.sql import functions as F

from scriptorium.operators.replace import PARAGRAPH_KEYS, joined_apart, rewritten_runs, with_new_texts
from scriptorium.session import unsorted

PARAGRAPH = ["doc_id", "idx"]
# indexes of content edits count body paragraphs only
BODY = "body"
BLOCK = ["doc_id", "page_num", "block_no"]


def body_paragraphs(paragraphs):
    """Body paragraphs of a table with scopes; all of a table without."""
    return paragraphs.where(F.col("scope") == BODY) if "scope" in paragraphs.columns else paragraphs


def checked_edits(edits, catalog, pages):
    """Add ``valid`` and ``reason``: which edits the format of their document can take.

    Paragraph documents need ``idx``. Page documents need ``page_num`` and ``block_no``,
    a page that exists and, where the table has a ``bbox``, a non-empty one. The new
    text may be empty but not null.
    """
    typed = edits.join(catalog.select("doc_id", "file_type"), "doc_id", "left")
    known = pages.select("doc_id", "page_num", F.lit(True).alias("page_exists"))
    located = typed.join(known, ["doc_id", "page_num"], "left")
    docx, pdf = F.col("file_type") == "docx", F.col("file_type") == "pdf"
    no_region = F.lit(False)
    if "bbox" in edits.columns:
        no_region = F.coalesce(F.size("bbox"), F.lit(0)) <= 0
    reason = (
        F.when(~F.coalesce(docx | pdf, F.lit(False)), "unsupported")
        .when(docx & F.col("idx").isNull(), "no_index")
        .when(pdf & (F.col("page_num").isNull() | F.col("block_no").isNull()), "no_address")
        .when(pdf & F.col("page_exists").isNull(), "no_such_page")
        .when(pdf & no_region, "no_region")
        .when(F.col("text").isNull(), "no_text")
        .otherwise("")
    )
    return located.select(
        *edits.columns, "file_type", reason.alias("reason"), (reason == "").alias("valid")
    )


def latest_edits(edits, keys):
    """Text of the last edit per address; a plain aggregate, combined before the exchange.

    An edit without text is no edit and hides none before it.
    """
    addressed = edits.where(" AND ".join(f"{key} IS NOT NULL" for key in [*keys, "text"]))
    return addressed.groupBy(*keys).agg(F.max_by("text", "seq").alias("new_text"))


def _apply(content, latest, keys):
    def join(rows):
        return rows.join(unsorted(latest), keys, "left")

    edited = joined_apart(content, join) if "runs" in content.columns else join(content)
    return edited.withColumn(
        "changed", F.col("new_text").isNotNull() & ~F.col("new_text").eqNullSafe(F.col("text"))
    ).withColumn("new_text", F.coalesce("new_text", "text"))


def apply_paragraph_edits(paragraphs, edits):
    """Last edit per index wins, unknown indexes are ignored; adds ``new_text, changed``.

    Of a table with scopes only body paragraphs are edited.
    """
    latest, keys = latest_edits(edits, PARAGRAPH), PARAGRAPH
    if "scope" in paragraphs.columns:
        latest, keys = latest.withColumn("scope", F.lit(BODY)), [*PARAGRAPH, "scope"]
    return _apply(paragraphs, latest, keys)


def apply_block_edits(blocks, edits):
    """Last edit per page and block wins; an edit of a page without blocks meets nothing."""
    return _apply(blocks, latest_edits(edits, BLOCK), BLOCK)


def edit_runs(runs, edited=None):
    """Carry changed paragraphs ``(doc_id, scope, idx, new_text)`` over to their runs.

    The first run takes the new text, the others become empty, and a paragraph without
    runs gets one. Without ``edited``, ``runs`` are edited paragraphs that have their ``runs`` with them,
    and nothing more is exchanged.
    """
    if edited is None:
        return rewritten_runs(runs.withColumn("new_text", F.when(F.col("changed"), F.col("new_text"))))
    return with_new_texts(runs, edited.where("changed").select(*PARAGRAPH_KEYS, "new_text"))


def edits_by_page(edits):
    """Edits submitted per page: how many, for how many blocks, first and last."""
    addressed = edits.where("page_num IS NOT NULL AND block_no IS NOT NULL")
    per_block = addressed.groupBy(*BLOCK).agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )
    return per_block.groupBy("doc_id", "page_num").agg(
        F.sum("n").alias("n_edits"),
        F.count("*").alias("n_blocks"),
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
    )


def edit_counts(paragraphs, edits):
    """Per document: edits submitted, distinct indexes addressed, body paragraphs changed.

    Paragraphs meet only the latest edits in an inner join, so a small set of edits is
    broadcast and the paragraphs are not shuffled.
    """
    zero = F.lit(0).cast("long")
    latest = edits.groupBy(*PARAGRAPH).agg(
        F.count("*").alias("n_submitted"),
        F.max_by("text", F.when(F.col("text").isNotNull(), F.col("seq"))).alias("new_text"),
    )
    submitted = latest.select(
        "doc_id",
        "n_submitted",
        F.col("idx").isNotNull().cast("long").alias("n_pending"),
        zero.alias("n_changed"),
    )
    effective = body_paragraphs(paragraphs).join(latest, PARAGRAPH).select(
        "doc_id",
        zero.alias("n_submitted"),
        zero.alias("n_pending"),
        F.coalesce(F.col("text") != F.col("new_text"), F.lit(False)).cast("long").alias("n_changed"),
    )
    return (
        submitted.unionByName(effective)
        .groupBy("doc_id")
        .agg(*(F.sum(c).alias(c) for c in ("n_submitted", "n_pending", "n_changed")))
    )
