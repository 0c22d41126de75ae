import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm.quality import fit, isotonic, op8_quality, quality
from scriptorium.llm.statistics import NAMES, statistics

SCHEMA = "doc_id long, quality int, toxic int"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 1)), min_size=1, max_size=20))
def test_isotonic_is_the_best_rising_fit(points):
    x, y = (np.array(v, float) for v in zip(*points))
    knots, levels = isotonic(x, y)
    assert (np.diff(levels) >= -1e-12).all() and (np.diff(knots) >= 0).all()
    fitted = np.interp(x, knots, levels)
    # minimax formula of isotonic regression over distinct x
    for value in set(x):
        want = max(
            min(y[(x >= a) & (x <= b)].mean() for b in x[x >= value]) for a in x[x <= value]
        )
        assert np.allclose(fitted[x == value], want)


def test_statistics_of_empty_and_plain_texts():
    table = statistics(pa.array(["", None, "one two\ntwo two", " " * 9]))
    assert table.shape == (4, len(NAMES)) and np.isfinite(table).all()
    assert (table[0] == 0).all() and (table[1] == 0).all()
    plain = dict(zip(NAMES, table[2]))
    assert np.isclose(plain["log_words"], np.log(5)) and np.isclose(plain["distinct_words"], 0.5)
    assert np.isclose(plain["repeats"], 0.5)


def test_without_labels(documents, table):
    docs = documents("a b", "")
    for marks, score in (([], 0.0), ([(0, 1, 1)], 1.0), ([(1, 0, 1), (None, 1, 1)], 0.0)):
        found = quality(docs, fit(docs, table(SCHEMA, *marks))).collect()
        assert [r["score"] for r in found] == [score, score]


def test_awkward_rows(clashing, table):
    marks = table(SCHEMA, (3, 1, 1), (3, 0, 0), (5, 0, 0), (0, None, None), (1, 0, None))
    found = quality(clashing, fit(clashing, marks)).collect()
    assert len(found) == clashing.count()
    assert all(0 <= r["score"] <= 1 for r in found)
    assert quality(clashing.limit(0), fit(clashing, marks)).count() == 0


def test_held_out_accuracy(spark):
    found = op8_quality(spark, "/root/testdata/sf0.01")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = found.join(marks, "doc_id").where("held_out").collect()
    assert found.count() == 1000
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
