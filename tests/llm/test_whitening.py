import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm.whitening import eigenvectors, op12_whitening, whiten

SCHEMA = "vec_id long, embedding array<float>, component string, n string, x string, v string"


def wide(*values):
    return [(i, v, "clash", "clash", "clash", "clash") for i, v in values]


def check_vectors(a, values, x, tolerance=1e-13):
    size = np.abs(a).max()
    assert (np.diff(values) <= 1e-15 * size).all()
    assert np.abs(x.T @ x - np.eye(len(a))).max() < tolerance
    assert np.abs(a @ x - x * values).max() < tolerance * size


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.integers(0, 10**6), st.sampled_from([1e-3, 1e-6, 1e-9, 0.0]))
def test_clusters_of_eigenvalues(d, seed, gap):
    rng = np.random.default_rng(seed)
    values = np.sort(rng.integers(1, 4, d) + gap * rng.random(d))[::-1]
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = eigenvectors(a)
    check_vectors(a, found, x)
    assert np.allclose(found, values, rtol=1e-13)


def test_refined_beyond_float32():
    rng = np.random.default_rng(3)
    a = np.cov(rng.normal(size=(40, 64)), rowvar=False)  # of rank 39
    values, x = eigenvectors(a)
    check_vectors(a, values, x)
    want = np.linalg.eigh(a)
    close = np.abs(np.abs((want[1][:, ::-1] * x).sum(axis=0)) - 1)
    assert close[:8].max() < 1e-12 and np.allclose(values, want[0][::-1], rtol=1e-10, atol=1e-12)


def plain(vectors, k=8):
    """The contract on whole matrices."""
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    z = x - sums / n
    values, q = np.linalg.eigh(z.T @ z / n)
    values, q = values[::-1][:k], q[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(axis=1), z @ q / np.sqrt(values), values / np.trace(z.T @ z / n)


def test_query_equals_plain(spark):
    folder = "/root/testdata/sf0.01"
    source = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    n, deviation, white, explained = plain(source["embedding"].tolist())
    frame = op12_whitening(spark, folder).toPandas()
    assert len(frame) == 8 * len(source) and (frame["n"] == n).all()
    assert frame["identity_error"].nunique() == 1 and frame["identity_error"][0] < 1e-9
    by_id = dict(zip(source["vec_id"], range(n)))
    row, c = frame["vec_id"].map(by_id).to_numpy(), frame["component"].to_numpy() - 1
    assert (frame["deviation"].to_numpy() == deviation[row]).all()
    assert np.allclose(frame["explained"], explained[c], rtol=1e-9)
    found = np.zeros((n, 8))
    found[row, c] = frame["whitened"]
    sign = np.sign((found * white).sum(axis=0))
    assert np.abs(found - sign * white).max() < 1e-9


def test_awkward_rows(table):
    rng = np.random.default_rng(1)
    good = [rng.normal(size=3).tolist() for _ in range(6)]
    good += [[0.0, 0.0, 0.0], good[0], [3.0e4, -3.0e4, 1.0]]
    ids = [1, 1, None, 4, 5, 6, 7, 8, 9]
    bad = [None, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [1.0, float("inf"), 0.0]]
    rows = table(SCHEMA, *wide(*zip(ids, good), *((20 + i, v) for i, v in enumerate(bad))))
    found = whiten(rows).toPandas()
    assert len(found) == len(good) * 3 and set(found["component"]) == {1, 2, 3}
    assert found["vec_id"].isna().sum() == 3 and not (found["vec_id"] >= 20).any()
    n, deviation, white, _ = plain(np.float32(good))
    assert sorted(found["deviation"]) == sorted(np.repeat(deviation, 3))
    assert (found["identity_error"] < 1e-6).all()
    assert whiten(rows.limit(0)).count() == 0
    assert whiten(rows.where("vec_id >= 20")).columns == found.columns.tolist()


def test_no_spread_has_no_components(table):
    assert whiten(table(SCHEMA, *wide((1, [1.0, 2.0])))).count() == 0
    assert whiten(table(SCHEMA, *wide((1, [1.0, 2.0]), (2, [1.0, 3.0])))).count() == 2
    assert whiten(table(SCHEMA, *wide((1, [])))).count() == 0


def test_lengths_must_agree(table):
    with pytest.raises(ValueError):
        whiten(table(SCHEMA, *wide((1, [1.0]), (2, [1.0, 2.0]))))


def test_deviation_beyond_a_long_is_null(table):
    found = whiten(table(SCHEMA, *wide((1, [3e9]), (2, [-3e9]), (3, [0.0])))).toPandas()
    assert found["deviation"].isna().tolist().count(True) == 2
