"""Training corpus from raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept. All
but the last return the columns of ``documents``; the last adds domain, rate and copies.
Empty documents stay unless a stage empties them itself: the line stage drops those whose last
words were repeats, the benchmark stage those that are benchmark passages for the most part.
"""

from scriptorium.llm.decontaminate import decontaminate
from scriptorium.llm.line_dedup import drop_repeated_lines
from scriptorium.llm.mixing import language_quality, mix
from scriptorium.llm.near_dedup import drop_near_duplicates
from scriptorium.llm.tables import load, staged
from scriptorium.llm.toxicity import drop_toxic, training_labels


def toxicity(spark, docs, sf_dir):
    """Toxic documents go."""
    return drop_toxic(docs, training_labels(load(spark, sf_dir, "labels")))


def line_dedup(spark, docs, sf_dir):
    """Blocks of lines that an earlier document has go from later ones."""
    return drop_repeated_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """Of each group of near copies, similarity 0.8 or more, the smallest id stays."""
    return drop_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    """Benchmark passages go; documents made of them for the most part go whole."""
    return decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mixing(spark, docs, sf_dir):
    """Rates and copies that bring the domains to their target weights."""
    return mix(docs, language_quality(docs, load(spark, sf_dir, "labels")))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# learned scores, alignment and components are not SQL
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on the documents table, each written before the next reads it."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
