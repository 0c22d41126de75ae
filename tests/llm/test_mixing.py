import random

import numpy as np

from scriptorium.llm import mixing
from scriptorium.llm.mixing import fit_classifier, fit_rates, language_quality, mix, op6_mixing, rates

DOMAINS = "doc_id long, domain string"


def corpus(n=300):
    rng = random.Random(4)
    letters = {"x": "abcdefg", "y": "nopqrst", "z": "0123456"}
    texts, marks = [], []
    for i in range(n):
        domain = rng.choices("xyz", [6, 3, 1])[0]
        words = ["".join(rng.choice(letters[domain]) for _ in range(4)) for _ in range(rng.randint(5, 40))]
        texts.append(" ".join(words))
        marks.append((i, domain))
    return texts, marks


def test_totals_match_targets(documents, table):
    texts, marks = corpus()
    docs, domains = documents(*texts), table(DOMAINS, *marks[:150], (9999, "x"), (None, "y"), (5, None))
    targets = {"x": 0.2, "y": 0.3, "z": 0.5}
    found = mix(docs, domains, targets).collect()
    assert sum(r["domain"] != d for r, (_, d) in zip(sorted(found), marks)) <= 3
    total = sum(r["n_tokens"] for r in found)
    for domain, share in targets.items():
        own = sum(r["n_tokens"] * r["rate"] for r in found if r["domain"] == domain)
        assert abs(own / total - share) < 0.02
    assert all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 for r in found)


def test_rates_stay_nonnegative_and_reach_the_least_squares_point(documents, table):
    texts, marks = corpus()
    docs = documents(*texts)
    classifier = fit_classifier(docs, table(DOMAINS, *marks))
    steps = fit_rates(docs, classifier, {"x": 0.0, "y": 0.05, "z": 0.95})
    p = np.eye(3)
    assert (rates(p, steps) >= 0).all() and rates(p, steps)[0] < 0.05
    assert fit_rates(docs, classifier, {"unknown": 1.0}) == []


def least_squares(n, p, wanted, passes=20_000):
    """Plain nonnegative least squares by accelerated projected gradient on all rates."""
    a = (n[:, None] * p).T
    step = 1 / np.linalg.norm(a @ a.T, 2)
    r = last = np.ones(len(n))
    for i in range(passes):
        y = r + (i / (i + 3)) * (r - last)
        r, last = np.maximum(0, y - step * (a.T @ (a @ y - wanted))), r
    return a @ r


def test_totals_equal_plain_least_squares(documents, table, monkeypatch):
    rng = np.random.default_rng(8)
    for sharp, reachable in ((8.0, True), (1.5, True), (0.5, False)):
        k, rows = 5, 400
        n = rng.integers(1, 200, rows).astype(float)
        logits = rng.normal(size=(rows, k)) * sharp
        logits[: rows // 3, 0] += 3 * sharp  # the hot domain
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        if not reachable:
            p = 0.7 * p + 0.3 / k
        weights = np.array([0.01, 0.03, 0.16, 0.3, 0.5] if reachable else [0, 0, 0, 0, 1.0])
        packed = table("n double, p array<double>", *((float(a), b.tolist()) for a, b in zip(n, p)))
        monkeypatch.setattr(mixing, "staged", lambda df, label: packed)
        classifier = mixing.Classifier([str(i) for i in range(k)])
        steps, gap = mixing.solve_rates(
            documents("a"), classifier, {str(i): w for i, w in enumerate(weights)}
        )
        wanted = weights * n.sum()
        found, best = (n * rates(p, steps)) @ p, least_squares(n, p, wanted)
        off, least = (np.linalg.norm(x - wanted) / n.sum() for x in (found, best))
        assert off <= least + 2e-4 and (gap <= mixing.CLOSE) == reachable, (off, least, gap)
        assert np.isclose(gap, np.abs(found - wanted).sum() / n.sum(), rtol=1e-6)


def test_without_labels_all_rates_are_one(documents, table):
    found = mix(documents("a b", None, ""), table(DOMAINS)).collect()
    assert [(r["rate"], r["copies"], r["domain"]) for r in found] == [(1.0, 1, None)] * 3
    assert [r["n_tokens"] for r in found] == [2, 0, 0]


def test_awkward_rows(clashing, table):
    domains = table(DOMAINS, (3, "b"), (3, "a"), (5, "a"), (6, "b"))
    found = mix(clashing, domains, {"a": 1.0, "b": 1.0})
    assert found.count() == clashing.count()
    assert set(found.columns) == {*clashing.columns, "probability", "target_gap"}
    assert mix(clashing.limit(0), domains).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    found = op6_mixing(spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    marks = language_quality(docs, spark.read.parquet(f"{folder}/labels.parquet")).toPandas()
    both = found.merge(marks, on="doc_id")
    assert len(found) == 1000 and (both["domain_x"] == both["domain_y"]).mean() > 0.95
    shares = (found["n_tokens"] * found["rate"]).groupby(found["domain"]).sum() / found["n_tokens"].sum()
    assert abs(shares["en-1"] - 0.45) < 0.03 and abs(shares["de-1"] - 0.18) < 0.03
