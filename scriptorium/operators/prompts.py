"""Edit prompts as work on documents: their slots become rules and style patches."""

from functools import reduce

from pyspark.sql import functions as F

from scriptorium.functions.prompts import prompt_slots
from scriptorium.operators.replace import (
    BODY_AND_TABLES, matches_by_rule, replace_blocks_by_rule, replace_by_rule,
)
from scriptorium.operators.style import apply_run_style

SLOT_NAMES = ("action", "old_text", "new_text", "page", "font_name", "font_size", "alignment")


def parsed_prompts(prompts):
    """Add the slots of each ``prompt``; all null where it is no command."""
    return prompts.withColumn("_slots", prompt_slots(F.col("prompt"))).select(
        *prompts.columns, *(F.col(f"_slots.{name}") for name in SLOT_NAMES)
    )


def prompt_rules(parsed):
    """Replacing and deleting commands as caseless rules of their document, in their order.

    ``page`` counts from 0 as pages of contents do.
    """
    return parsed.where("action IN ('replace_text', 'delete_text')").select(
        "doc_id", F.col("command_id").alias("seq"), F.col("old_text").alias("find_text"),
        F.coalesce("new_text", F.lit("")).alias("replace_text"),
        F.lit(False).alias("case_sensitive"), (F.col("page") - 1).alias("page"),
    )


def prompt_styles(parsed):
    """Font commands as style patches; those limited to a page are left out, runs have none."""
    return parsed.where("action = 'change_font' AND page IS NULL").select(
        "doc_id", F.col("command_id").alias("seq"), "font_name", "font_size",
        *(F.lit(None).cast("string").alias(c) for c in ("header_text", "footer_text")),
    )


def apply_prompts(paragraphs, blocks, runs, prompts):
    """Run every understood prompt over its document.

    ``(paragraphs, blocks, runs, matches)``: texts after all rules in order, runs after the last font
    name and size, and one row per rule with its matches. Rules for one page concern blocks only:
    paragraphs have no pages.
    """
    parsed = parsed_prompts(prompts)
    rules = prompt_rules(parsed)
    searched = paragraphs.where(F.col("scope").isin(BODY_AND_TABLES))
    texts = replace_by_rule(searched, rules.where("page IS NULL"))
    pages = replace_blocks_by_rule(blocks, rules)
    hits = matches_by_rule(texts, pages)
    counted = rules.join(hits, ["doc_id", "seq"], "left").select(
        F.col("seq").alias("command_id"), "doc_id",
        F.coalesce("matches", F.lit(0)).cast("long").alias("matches"),
    )
    return texts, pages, apply_run_style(runs, prompt_styles(parsed)), counted


def slot_accuracy(prompts):
    """Per slot: prompts whose slot equals ``gold_<slot>``, nulls included, and their share."""
    parsed = parsed_prompts(prompts)
    exact = parsed.agg(F.count("*").alias("n_prompts"), *(
        F.count_if(F.col(n).eqNullSafe(F.col(f"gold_{n}"))).alias(n) for n in SLOT_NAMES
    ))
    rows = [
        exact.select(F.lit(n).alias("slot"), "n_prompts", F.col(n).alias("n_exact")) for n in SLOT_NAMES
    ]
    share = F.when(F.col("n_prompts") > 0, F.round(F.col("n_exact") / F.col("n_prompts"), 6))
    return reduce(lambda a, b: a.unionByName(b), rows).withColumn("share", share)
