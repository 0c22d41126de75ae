import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(table):
    """``documents(*texts)``: rows with ids from 0; a pair gives the id itself."""
    def make(*texts):
        rows = []
        for i, text in enumerate(texts):
            doc_id, text = text if isinstance(text, tuple) else (i, text)
            rows.append((doc_id, text, "en", "src0", len(text) if text is not None else None))
        return table(DOCS, *rows)

    return make


@pytest.fixture
def clashing(documents):
    """Awkward rows: nulls, blanks, ties, repeats, a very long text, columns of clashing names."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = documents(
        None, "", " \n\t ", "one two", "one two", long, long + " more", (None, "no id here"),
        (3, "one two"), "x" * 50_000,
    )
    for name in (
        "n", "n_shingles", "node", "component", "key", "score", "label", "spans", "print", "items",
        "line", "position", "found", "gone", "kept", "word", "c", "rate", "copies", "domain",
        "n_tokens", "edits", "chars", "tokens", "toxic", "quality", "p", "q", "a", "b", "entry",
    ):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows
