"""How well commands are understood and how much formatting an edit keeps."""

from pyspark.sql import functions as F

from scriptorium.operators.replace import PARAGRAPH_KEYS, parsed_commands
from scriptorium.session import parts_of


def slot_exact_match(commands):
    """Share of prompts whose parsed slots equal ``gold_find`` and ``gold_replace``.

    Both gold slots are null for a prompt that is no command.
    """
    match = F.col("find_text").eqNullSafe(F.col("gold_find")) & F.col("replace_text").eqNullSafe(
        F.col("gold_replace")
    )
    scored = parsed_commands(commands).withColumn("match", match.cast("long"))
    return scored.agg(
        F.count("*").alias("n_prompts"),
        F.sum("match").alias("n_exact"),
        F.round(F.avg("match"), 6).alias("share"),
    )


def style_preservation(before, after):
    """Runs per document, and how many kept both font name and font size.

    Of paragraphs with their ``runs`` both tables are exchanged by paragraph, without texts and in parts
    of bounded size; runs are compared within it.
    """
    if "runs" in before.columns:
        counts = _kept_in_paragraphs(before, after)
        return _share(counts.groupBy("doc_id").agg(F.sum("n").alias("n_runs"), F.sum("kept").alias("n_kept")))
    keys = ["doc_id", "scope", "idx", "run_no"]
    old = before.select(
        *keys, F.col("font_name").alias("old_name"), F.col("font_size").alias("old_size")
    )
    both = after.select(*keys, "font_name", "font_size").join(old, keys)
    kept = F.col("font_name").eqNullSafe(F.col("old_name")) & F.col("font_size").eqNullSafe(
        F.col("old_size")
    )
    return _share(both.groupBy("doc_id").agg(F.count("*").alias("n_runs"), F.count_if(kept).alias("n_kept")))


def _share(counts):
    return counts.withColumn("share", F.round(F.col("n_kept") / F.col("n_runs"), 6))


FONT = ["font_name", "font_size"]


def _kept_in_paragraphs(before, after):
    """``(doc_id, n, kept)`` of each paragraph with runs in both tables, matched by number."""
    parts = parts_of(before)

    def dealt(table, name):
        fields = (F.col(f"runs.{c}").alias(f"{name}_{c}") for c in ("run_no", *FONT))
        return table.select(*PARAGRAPH_KEYS, *fields).repartition(parts, *PARAGRAPH_KEYS)

    def rows(name):
        return F.arrays_zip(*(F.col(f"{name}_{c}").alias(c) for c in ("run_no", *FONT)))

    def same(one, other):
        return one[FONT[0]].eqNullSafe(other[FONT[0]]) & one[FONT[1]].eqNullSafe(other[FONT[1]])

    both = dealt(after, "new").join(dealt(before, "old"), PARAGRAPH_KEYS).select(
        "doc_id", rows("new").alias("new"), rows("old").alias("old")
    )
    # mostly the runs are the same ones in the same order; only others are looked up one by one
    aligned = F.col("new.run_no") == F.col("old.run_no")
    kept = F.zip_with("new", "old", same)

    def found(one):
        return F.exists("old", lambda other: one["run_no"] == other["run_no"])

    def kept_of(one):
        return F.exists("old", lambda other: (one["run_no"] == other["run_no"]) & same(one, other))

    n = F.when(aligned, F.size("new")).otherwise(F.size(F.filter("new", found)))
    n_kept = F.when(aligned, F.size(F.filter(kept, lambda k: k))).otherwise(F.size(F.filter("new", kept_of)))
    return both.select("doc_id", n.cast("long").alias("n"), n_kept.cast("long").alias("kept")).where("n > 0")
