"""Content tables: documents to paragraphs, pages to text blocks."""

from pyspark.sql import functions as F

from scriptorium.functions.text import strip_text
from scriptorium.operators.edits import body_paragraphs
from scriptorium.operators.ordinals import with_ordinal

TEXT_BLOCK = 0
# Page labels and texts shown for empty content.
PAGE_LABEL = "Page "
BLANK_PAGE_TEXT = "This page appears to be blank."


def content_paragraphs(docs):
    """``(doc_id, text)`` to ``(doc_id, idx, text)``: 0-based, empty paragraphs kept."""
    pieces = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return pieces.select("doc_id", F.col("pos").cast("long").alias("idx"), "text")


def valid_blocks(raw_blocks):
    """Text blocks with something in them, stripped; block numbers keep their gaps."""
    return (
        raw_blocks.where(F.col("block_type") == TEXT_BLOCK)
        .withColumn("text", strip_text(F.col("text")))
        .where(F.col("text") != "")
        .select("doc_id", "page_num", "block_no", "text")
    )


def content_blocks(pages, raw_blocks):
    """Valid blocks plus one row with a null block for every page without any.

    Only page keys are shuffled to find the blank pages; block texts stay in place.
    """
    blocks = valid_blocks(raw_blocks)
    filled = blocks.select("doc_id", "page_num").distinct()
    blank = pages.select("doc_id", "page_num").join(filled, ["doc_id", "page_num"], "left_anti")
    return blocks.unionByName(blank, allowMissingColumns=True)


def nested_blocks(nested):
    """Flatten ``(doc_id, pages array<page_num, blocks array<bbox, text, block_no>>)``."""
    pages = nested.select("doc_id", F.inline("pages"))
    return pages.select("doc_id", "page_num", F.inline_outer("blocks"))


def page_ordinals(pages, keys, order):
    """Number pages from 0 within their document, in ``order``."""
    return with_ordinal(pages, keys, order, "page_num")


def content_all(catalog, paragraphs, blocks):
    """One content table for both formats: body paragraphs of docx, blocks of pdf documents."""
    typed = catalog.select("doc_id", "file_type")
    docx = typed.where(F.col("file_type") == "docx").join(
        body_paragraphs(paragraphs), "doc_id"
    )
    pdf = typed.where(F.col("file_type") == "pdf").join(blocks, "doc_id")
    return docx.unionByName(pdf, allowMissingColumns=True)


def page_stats(pages, blocks):
    """Blocks per page; blank pages are listed with 0."""
    keys = ["doc_id", "page_num"]
    listed = pages.select(*keys, F.lit(0).cast("long").alias("n"))
    found = blocks.where(F.col("block_no").isNotNull()).select(
        *keys, F.lit(1).cast("long").alias("n")
    )
    counts = listed.unionByName(found).groupBy(*keys).agg(F.sum("n").alias("n_blocks"))
    return counts.withColumn("is_blank", F.col("n_blocks") == 0)


def document_stats(pages, blocks):
    """Pages, blank pages and blankness per document."""
    return (
        page_stats(pages, blocks)
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("n_pages"),
            F.sum("n_blocks").alias("n_blocks"),
            F.count_if("is_blank").alias("n_blank_pages"),
        )
        .withColumn("is_blank", F.col("n_blocks") == 0)
    )


def page_labels(pages, blocks):
    """Label of every page, and the placeholder shown on blank ones."""
    return page_stats(pages, blocks).select(
        "doc_id",
        "page_num",
        F.concat(F.lit(PAGE_LABEL), F.col("page_num") + 1).alias("label"),
        F.when(F.col("is_blank"), F.lit(BLANK_PAGE_TEXT)).otherwise("").alias("placeholder"),
    )
