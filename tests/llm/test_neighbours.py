import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import neighbours
from scriptorium.llm.neighbours import nearest, op7_neighbours, probes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, chosen, wanted=5):
    ids = np.array(sorted(vectors))
    table = np.array([vectors[i] for i in ids], float)
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    out = {}
    for at in np.flatnonzero(chosen(ids)):
        scores = table @ table[at]
        order = [i for i in np.lexsort((ids, -np.round(scores, 12))) if i != at][:wanted]
        out[int(ids[at])] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def results(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def same(found, want):
    assert {q: [i for i, _ in r] for q, r in found.items()} == {q: [i for i, _ in r] for q, r in want.items()}
    for q, pairs in want.items():
        assert np.allclose([s for _, s in found[q]], [s for _, s in pairs], atol=1e-12)


def test_small_tables_are_exact(table):
    rng = np.random.default_rng(0)
    vectors = {i: rng.normal(size=6).round(3).tolist() for i in range(120)}
    for i in range(30, 60):
        vectors[i] = vectors[30]  # more equal ones than an answer holds
    vectors[70] = [2 * x for x in vectors[71]]
    rows = [(i, v, 0) for i, v in vectors.items()]
    rows += [(500, None, 0), (501, [], 0), (502, [0.0] * 6, 0), (503, [1.0, None] * 3, 0), (None, vectors[3], 0),
             (504, [float("nan")] * 6, 0), (505, [float("inf")] * 6, 0), (506, [1.0, 2.0], 0), (7, vectors[7], 1)]
    frame = table(SCHEMA, *rows).withColumn("vector", F.lit("clash")).withColumn("entry", F.lit(1))
    same(results(nearest(frame, F.col("vec_id") % 10 == 0)), brute(vectors, lambda i: i % 10 == 0))


def test_fewer_candidates_than_wanted(table):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)]
    found = results(nearest(table(SCHEMA, *rows), F.col("vec_id") == 0))
    assert [i for i, _ in found[0]] == [2, 1]
    assert results(nearest(table(SCHEMA), F.col("vec_id") == 0)) == {}
    assert results(nearest(table(SCHEMA, (0, [1.0], 0)), F.col("vec_id") == 0)) == {}


def test_probes_come_in_order_and_reach_the_target():
    found = probes(np.array([0.2, 0.9]), 1.0, 0.9)
    assert found[0] == (0, 0) and len(found) == len(set(found))
    lots = probes(np.array([0.2, 0.9]), 1.0, 0.999)
    assert lots[: len(found)] == found and len(lots) > len(found)
    assert probes(np.array([]), 1.0, 0.9) == [()]


def test_many_buckets_splits_and_searches_that_find_too_few(table, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 8)
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 16)
    rng = np.random.default_rng(1)
    vectors = {i: (rng.normal(size=8) + 4 * (i % 3 == 0)).round(3).tolist() for i in range(300)}
    frame = table(SCHEMA, *[(i, v, 0) for i, v in vectors.items()])
    want = brute(vectors, lambda i: i % 25 == 0)
    found = results(nearest(frame, F.col("vec_id") % 25 == 0, target=0.999))
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    # next to no probes: those who find too few are held against all rows
    few = results(nearest(frame, F.col("vec_id") % 25 == 0, target=1e-6))
    assert all(len(r) == 5 for r in few.values())


def test_recall_on_the_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    want = brute({r["vec_id"]: r["embedding"] for r in rows}, lambda i: i % 50 == 0)
    found = results(op7_neighbours(spark, "/root/testdata/sf0.1"))
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(found) == set(want) and hits >= 0.95 * 5 * len(want)
