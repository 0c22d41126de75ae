"""Audit history as an append-only table; the array in the catalog is a view of it."""

from functools import reduce

from pyspark.sql import functions as F

from scriptorium.functions.audit import (
    UPLOAD_ACTION,
    content_action,
    replace_action,
    style_action,
)
from scriptorium.operators.ordinals import with_ordinal


def _entries(rows, seq, date, action):
    return rows.select("doc_id", seq.alias("seq"), date.alias("date"), action.alias("action"))


def upload_entries(uploads, seq):
    return _entries(uploads, seq, F.col("upload_date"), F.lit(UPLOAD_ACTION))


def style_entries(patches, seq, date):
    image_index = (
        F.col("image_index") if "image_index" in patches.columns else F.lit(None).cast("long")
    )
    fields = (F.col(c) for c in ("font_name", "font_size", "header_text", "footer_text"))
    return _entries(patches, seq, date, style_action(*fields, image_index))


def content_entries(counts, seq, date):
    """From ``edit_counts``: every submission is logged with all its items."""
    return _entries(counts, seq, date, content_action(F.col("n_submitted")))


def replace_entries(totals, find_text, replace_text, seq, date):
    """From ``replaced_totals``: only documents with matches are logged."""
    action = replace_action(F.lit(find_text), F.lit(replace_text), F.col("matches"))
    return _entries(totals.where(F.col("matches") > 0), seq, date, action)


def history_append(history, *entries):
    return reduce(lambda a, b: a.unionByName(b), entries, history)


def history_timeline(history):
    """Add ``entry_no``, from 0, oldest first, within each document."""
    return with_ordinal(history, ["doc_id"], "seq", "entry_no")
