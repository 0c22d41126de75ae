"""Fonts of runs; headers and footers of sections and pages."""

from pyspark.sql import functions as F

from scriptorium.functions.fonts import given_name, given_size, page_font, page_font_size
from scriptorium.operators.replace import BODY_AND_TABLES, joined_apart
from scriptorium.session import unsorted

PARTS = ["header", "footer"]


def effective_patches(patches):
    """One row per document: for each field the last value that a patch really set."""

    def last_set(value, name):
        return F.max_by(value, F.when(value.isNotNull(), F.col("seq"))).alias(name)

    return patches.groupBy("doc_id").agg(
        last_set(given_name(F.col("font_name")), "new_font_name"),
        last_set(given_size(F.col("font_size")), "new_font_size"),
        last_set(F.col("header_text"), "header_text"),
        last_set(F.col("footer_text"), "footer_text"),
    )


def apply_run_style(runs, patches):
    """Font name and size of every body and table run; '' and 0 leave the old value.

    ``runs`` are rows, or paragraphs with their ``runs``, which are met once per paragraph.
    """
    fonts = effective_patches(patches).select("doc_id", "new_font_name", "new_font_size")
    styled = F.col("scope").isin(BODY_AND_TABLES)

    def patched(column):
        new = F.coalesce(f"new_{column}", column)
        return F.when(styled, new).otherwise(F.col(column))

    def join(rows):
        return rows.join(unsorted(fonts), "doc_id", "left")

    if "runs" in runs.columns:
        def styled_run(run):
            new = {c: F.coalesce(F.col(f"new_{c}"), run[c]) for c in ("font_name", "font_size")}
            return run.withField("font_name", new["font_name"]).withField("font_size", new["font_size"])

        own = F.when(styled, F.transform("runs", styled_run)).otherwise(F.col("runs"))
        return joined_apart(runs, join).withColumn("runs", own).drop("new_font_name", "new_font_size")
    return (
        join(runs)
        .withColumns({c: patched(c) for c in ("font_name", "font_size")})
        .drop("new_font_name", "new_font_size")
    )


def page_fonts(patches):
    """Font and size used for page headers and footers."""
    return patches.select(
        "doc_id",
        page_font(F.col("font_name")).alias("page_font"),
        page_font_size(F.col("font_size")).alias("page_font_size"),
    )


def _by_part(patches):
    """``(doc_id, part, new_text)`` for every header or footer a patch sets."""
    parts = F.array(
        *(F.struct(F.lit(p).alias("part"), F.col(f"{p}_text").alias("new_text")) for p in PARTS)
    )
    unfolded = effective_patches(patches).select("doc_id", F.inline(parts))
    return unfolded.where(F.col("new_text").isNotNull())


def stamp_sections(section_list, sections, patches):
    """Set header and footer text of all sections of the patched documents.

    The first paragraph takes the text and the others become empty; a section part
    without paragraphs gets one. Null leaves a part alone, '' clears it.
    """
    wanted = _by_part(patches)
    text = (
        F.when(F.col("new_text").isNull(), F.col("text"))
        .when(F.col("para_no") == 0, F.col("new_text"))
        .otherwise("")
    )
    stamped = (
        sections.join(wanted, ["doc_id", "part"], "left").withColumn("text", text).drop("new_text")
    )
    first = sections.where(F.col("para_no") == 0).select("doc_id", "section_no", "part")
    added = (
        section_list.select("doc_id", "section_no")
        .join(wanted, "doc_id")
        .join(first, ["doc_id", "section_no", "part"], "left_anti")
        .withColumn("para_no", F.lit(0).cast("long"))
        .withColumnRenamed("new_text", "text")
    )
    return stamped.unionByName(added)


def stamp_pages(pages, patches):
    """One header and/or footer per page of the patched documents.

    The last patch that sets a part decides its text, and its own font goes with it.
    """
    fonts = page_font(F.col("font_name")), page_font_size(F.col("font_size"))
    stamp = F.struct("text", fonts[0].alias("page_font"), fonts[1].alias("page_font_size"))
    set_parts = F.array(
        *(F.struct(F.lit(p).alias("part"), F.col(f"{p}_text").alias("text")) for p in PARTS)
    )
    stamps = (
        patches.select("doc_id", "seq", "font_name", "font_size", F.inline(set_parts))
        .where(F.col("text").isNotNull())
        .groupBy("doc_id", "part")
        .agg(F.max_by(stamp, "seq").alias("stamp"))
    )
    return pages.select("doc_id", "page_num").join(stamps, "doc_id").select(
        "doc_id", "page_num", "part", "stamp.*"
    )
