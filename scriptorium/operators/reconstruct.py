"""Documents put together again from their rows, one row each.

A document's text is one value, so its rows have to meet in one group; the group is as large
as the text itself.
"""

from pyspark.sql import functions as F

from scriptorium.operators.edits import body_paragraphs


def _joined(rows, keys, order):
    in_order = F.array_sort(F.collect_list(F.struct(order, "text")))
    lines = F.transform(in_order, lambda row: F.coalesce(row["text"], F.lit("")))
    return rows.groupBy(*keys).agg(F.array_join(lines, "\n").alias("text"))


def reconstruct_documents(paragraphs):
    """``(doc_id, text)`` with the body paragraphs in order; null paragraphs are empty lines."""
    return _joined(body_paragraphs(paragraphs), ["doc_id"], "idx")


def reconstruct_pages(blocks):
    """``(doc_id, page_num, text)`` with the blocks of each page in order."""
    shown = blocks.where(F.col("block_no").isNotNull())
    return _joined(shown, ["doc_id", "page_num"], "block_no")
