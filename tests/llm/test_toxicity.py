import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm.tables import remainder
from scriptorium.llm.toxicity import (
    Model, drop_toxic, fit, op2_toxicity, segments, toxicity, training_labels,
)


def slow_segments(scores, offset=0):
    """Definition: the best segment, then the same left and right of it."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    best = max(
        ((total[e] - total[s], -(e - s), -s, s, e) for s in range(len(scores)) for e in range(s + 1, len(scores) + 1)),
        default=(0,),
    )
    if best[0] <= 0:
        return []
    *_, s, e = best
    return [
        *slow_segments(scores[:s], offset), (s + offset, e + offset, best[0]),
        *slow_segments(scores[e:], offset + e),
    ]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-1.0, -0.37, 0.71, 2.13]), max_size=14), st.integers(0, 99))
def test_segments_are_all_maximal_ones(scores, seed):
    # no two sums are equal, so the definition is unambiguous
    scores = np.array(scores) + np.random.default_rng(seed).uniform(0, 1e-3, len(scores))
    fast, slow = segments(scores), slow_segments(scores)
    assert [(s, e) for s, e, _ in fast] == [(s, e) for s, e, _ in slow]
    assert np.allclose([v for *_, v in fast], [v for *_, v in slow])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(600):
        words = [f"{rng.choice('abcdef')}{rng.randrange(300)}" for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "nasty"]))
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    return texts, labels


def test_learns_words_and_finds_their_places(documents, table, corpus):
    texts, labels = corpus
    docs = documents(*texts, "Such a VILE and rotten, nasty lot", "a fine day", "", None)
    marks = table("doc_id long, quality int, toxic int", *labels)
    found = {r["doc_id"]: r for r in toxicity(docs, fit(docs, marks)).collect()}
    wrong = sum((found[i]["score"] >= 0.5) != bool(toxic) for i, _, toxic in labels)
    assert wrong <= 6
    assert found[600]["score"] > 0.9 and found[601]["score"] < 0.1
    (passage,) = found[600]["passages"]
    assert (passage["start"], passage["end"]) == (2, 6)
    assert found[602]["score"] == found[603]["score"] < 0.5
    left = drop_toxic(docs, marks)
    assert left.columns == docs.columns
    kept = {r["doc_id"] for r in left.collect()}
    assert kept == {i for i, r in found.items() if r["score"] < 0.5}


def test_labels_of_the_held_out_fold_and_ids_are_not_used(documents, table, corpus):
    texts, labels = corpus
    docs = documents(*texts)
    marks = table("doc_id long, quality int, toxic int", *labels)
    turned = marks.withColumn("toxic", marks["toxic"] + (remainder(5) == 0).cast("int") * (1 - 2 * marks["toxic"]))
    one, two = fit(docs, training_labels(marks)), fit(docs, training_labels(turned.select(*marks.columns)))
    assert (one.keys == two.keys).all() and (one.slope, one.bias) == (two.slope, two.bias)


def test_without_labels(documents, table):
    docs = documents("a b", "")
    schema = "doc_id long, quality int, toxic int"
    for marks, share in (([], 0.0), ([(0, 1, 1)], 1.0), ([(0, 1, None), (9, 1, 1), (None, 1, 0)], 0.0)):
        scores = [r["score"] for r in toxicity(docs, fit(docs, table(schema, *marks))).collect()]
        assert scores == [share, share]


def test_awkward_rows(clashing, table):
    marks = table("doc_id long, quality int, toxic int", (3, 1, 1), (3, 0, 0), (5, 1, 0), (0, None, None))
    found = toxicity(clashing, fit(clashing, marks)).collect()
    assert len(found) == clashing.count()
    assert all(0 <= r["score"] <= 1 for r in found)
    assert toxicity(clashing.limit(0), Model()).count() == 0


def test_held_out_accuracy(spark):
    found = op2_toxicity(spark, "/root/testdata/sf0.01")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    joined = found.join(marks, "doc_id").collect()
    assert found.count() == 1000
    right = [r["predicted"] == r["toxic"] for r in joined]
    assert sum(right) / len(right) > 0.93
