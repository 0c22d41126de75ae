import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from reference import blank_words

from scriptorium.llm import lattice as lat
from scriptorium.llm.lm_score import lm_scores, op9_lm_score

MARK = lat.SPACE.encode()
PIECES = [
    (MARK, 1.0), (MARK + b"a", 2.0), (MARK + b"ab", 1.0), (b"a", 1.0), (b"b", 2.0), (b"ab", 1.0),
    (b"c", 0.5), (b"bc", 0.7),
]


def all_segmentations(word, stop=0.3):
    first = sum(w for p, w in PIECES if p.startswith(MARK))
    inner = sum(w for p, w in PIECES if not p.startswith(MARK))

    def rest(tail):
        own = stop if not tail else 0.0
        return own + sum(
            w / inner * (1 - stop) * rest(tail[len(p) :])
            for p, w in PIECES if not p.startswith(MARK) and tail.startswith(p)
        )

    return sum(
        w / first * rest(word[len(p) - len(MARK) :])
        for p, w in PIECES if p.startswith(MARK) and word.startswith(p.removeprefix(MARK))
    )


def test_lattice_sums_all_segmentations():
    words = [b"a", b"ab", b"abc", b"abab", b"cccc", b"bcbc", b"abcabcab", b"x", b"abx"]
    found = np.exp(lat.log_probabilities(lat.build(PIECES), words))
    assert np.allclose(found, [all_segmentations(w) for w in words], rtol=1e-12)


def test_word_probabilities_add_up_to_one():
    lattice = lat.build([(MARK, 1.0), (MARK + b"a", 1.0), (b"a", 1.0), (b"b", 1.0)])
    total, level = 0.0, [b""]
    for _ in range(14):
        total += np.exp(lat.log_probabilities(lattice, level)).sum()
        level = [w + c for w in level for c in (b"a", b"b")]
    assert 0.98 < total < 1 + 1e-9


def test_expected_uses_are_slopes_of_the_likelihood():
    lattice = lat.build(PIECES)
    words, counts = [b"abab", b"abc", b"a"], np.array([2.0, 1.0, 3.0])
    uses, stops = lat.expected_uses(lattice, words, counts)
    assert stops == 6
    for node in np.flatnonzero(np.isfinite(lattice.weights)):
        moved = lat.build(PIECES)
        moved.weights[node] += 1e-6
        moved.alone = moved.weights[lat.BEGIN]
        slope = (counts * (lat.log_probabilities(moved, words) - lat.log_probabilities(lattice, words))).sum() / 1e-6
        assert math.isclose(uses[node], slope, abs_tol=1e-4)


def test_long_words_and_odd_bytes():
    lattice = lat.build([*PIECES, *((bytes([i]), 0.1) for i in range(256))])
    words = [b"ab" * 20_000, "ñé".encode(), b"\xff", b""]
    assert np.isfinite(lat.log_probabilities(lattice, words)).all()


def brute_base(texts, training):
    counts = Counter()
    for i, text in texts:
        if training(i):
            counts.update([*blank_words(text), None])
    total, kinds = sum(counts.values()), len(counts)
    out = {}
    for i, text in texts:
        own = [*blank_words(text), None]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)
        out[i] = len(own), sum(counts[w] > 0 for w in own), total, base
    return out


@pytest.mark.parametrize("head", [2, 100_000])
def test_base_scores(documents, head):
    texts = list(enumerate(["a b a", "b c d d", "a new WORD", None, "", "a b"]))
    docs = documents(*(t for _, t in texts)).withColumn("training", F.col("doc_id") != 2).withColumn(
        "held_out", F.col("doc_id") == 2
    )
    want = brute_base(texts, lambda i: i != 2)
    for r in lm_scores(docs, head=head).collect():
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-12)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_nothing_to_learn_from(documents):
    docs = documents("a b", None).withColumns({"training": F.lit(False), "held_out": F.lit(True)})
    found = {r["doc_id"]: r for r in lm_scores(docs).collect()}
    assert found[0]["train_tokens"] == 0 and found[0]["base_score"] == 0
    assert found[0]["score"] < found[1]["score"] < 0
    assert lm_scores(docs.limit(0)).count() == 0


def test_awkward_rows(clashing):
    rows = clashing.withColumns({"training": F.lit(True), "held_out": F.lit(False)})
    found = {r["doc_id"]: r for r in lm_scores(rows).collect()}
    assert set(found) == {None, 0, 1, 2, 3, 4, 5, 6, 9} - {9} | {9}
    assert found[0]["n_tokens"] == 1 and found[3]["n_tokens"] == 6  # two rows of one id add up


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want = brute_base(rows, lambda i: not held(i))
    found = op9_lm_score(spark, sf_dir).collect()
    assert len(found) == len(rows)
    for r in found:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held(r["doc_id"]))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"])
