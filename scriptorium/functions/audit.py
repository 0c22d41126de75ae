"""Texts of the audit history."""

from pyspark.sql import functions as F

# History texts and the words for a missing value and for flags.
UPLOAD_ACTION = "Uploaded document"
STYLE_ACTION = "Updated styling: font=%s, size=%s, header=%s, footer=%s, img=%s"
CONTENT_ACTION = "Edited text content (%d block(s))"
REPLACE_ACTION = "Find & Replace: '%s' -> '%s' (%d matches)"
MISSING = "None"


def _shown(value):
    return F.coalesce(value.cast("string"), F.lit(MISSING))


def _given(value):
    return F.when(value.isNotNull(), F.lit("True")).otherwise(F.lit("False"))


def style_action(font_name, font_size, header_text, footer_text, image_index):
    """What was requested, not what changed: '' and 0 are shown as they came."""
    return F.format_string(
        STYLE_ACTION,
        _shown(font_name),
        _shown(font_size),
        _given(header_text),
        _given(footer_text),
        _given(image_index),
    )


def content_action(n_submitted):
    return F.format_string(CONTENT_ACTION, n_submitted)


def replace_action(find_text, replace_text, n_matches):
    return F.format_string(REPLACE_ACTION, find_text, replace_text, n_matches)
