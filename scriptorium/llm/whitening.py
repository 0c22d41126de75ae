"""Embedding whitening by mixed-precision refinement of covariance eigenvectors.

1. Every entry c becomes the integer ``floor(1024 * c) + 100000``. Count and sums per dimension come
   first; then each task centres its rows on the integer next to the mean and adds up their products,
   which are exact in float64 matrix products, to integers. Partial sums of partitions are
   added in a second set of tasks before a few of them reach the driver: d * d integers each. So the
   covariance is the exact rational one, rounded once.
2. Eigenvectors of the covariance in float32 are refined by Ogita-Aishima iterations: matrix products
   in extended precision give the correction of all vectors at once and its error falls
   quadratically. Eigenvalues too close to be told apart are a cluster: the covariance, shifted by
   their mean, is solved again within the span of their vectors, and the iteration goes on.
3. Each row is projected in its task; the covariance of the result is summed in the same way,
   centred first, and its largest departure from the identity goes with every row.

The model is d * d numbers, so it is bounded by the dimension. Components whose eigenvalue is zero
up to rounding (rank below d, a single row) have no whitened value and are left out.

Edge cases: rows whose vector is null, or holds null or non-finite entries, are dropped; zero and
repeated vectors and rows without id take part; vectors of different lengths are an error;
empty vectors and an empty table give no rows; a ``deviation`` beyond a long is null.
"""

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scriptorium.llm.tables import load

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
ROUNDS = 30
MERGES = 16
# integers up to here are exact in a float64 matrix product
EXACT = 1 << 53
RANK = 1e-12

WHITE = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double"
)


@dataclass
class Model:
    n: int
    sums: list  # exact, per dimension
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # dimensions x components
    trace: float


def fit_rows(rows):
    """``(vec_id, x)`` of the rows that take part, entries as integers."""
    rows = rows.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")
    ).where("v is not null")
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT))
    return rows.where(~odd).select("vec_id", whole.alias("x"))


def _matrix(batch):
    return np.asarray(batch["x"].flatten(), np.int64).reshape(batch.num_rows, -1)


def _sums(batches):
    n, total = 0, None
    for batch in batches:
        x = _matrix(batch)
        n += len(x)
        own = x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) > 1 << 40 else x.sum(axis=0)
        total = own.astype(object) if total is None else total + own
    if n:
        yield _packed([n, *total])


def _packed(numbers):
    return pa.RecordBatch.from_pydict({"numbers": [[str(int(x)) for x in numbers]]}, PACKED)


PACKED = pa.schema([("numbers", pa.list_(pa.string()))])


def _products(centre):
    """Sum of outer products of the centred rows, exact."""
    centre = np.array(centre, np.int64)

    def run(batches):
        total = None
        for batch in batches:
            z = _matrix(batch) - centre
            most = int(np.abs(z).max(initial=0))
            if most * most * len(z) < EXACT:
                own = np.rint((f := z.astype(np.float64)).T @ f).astype(np.int64).astype(object)
            else:
                own = (o := z.astype(object)).T @ o
            total = own if total is None else total + own
        if total is not None:
            yield _packed(total.reshape(-1))

    return run


def _added(batches):
    total = None
    for batch in batches:
        for numbers in batch["numbers"].to_pylist():
            own = np.array([int(x) for x in numbers], object)
            total = own if total is None else total + own
    if total is not None:
        yield _packed(total)


def _total(rows, run):
    """Partition sums added up in ``MERGES`` tasks, one at a time, and theirs here."""
    kind = "numbers array<string>"
    parts = rows.mapInArrow(run, kind)
    total = None
    for row in parts.repartition(MERGES).mapInArrow(_added, kind).toLocalIterator():
        own = np.array([int(x) for x in row["numbers"]], object)
        total = own if total is None else total + own
    return total


def covariance(n, sums, centre, products):
    """The exact covariance, each entry rounded once to extended precision."""
    d = len(sums)
    rest = [s - n * c for s, c in zip(sums, centre)]
    out = np.empty((d, d), np.longdouble)
    for i in range(d):
        for j in range(i, d):
            exact = n * products[i * d + j] - rest[i] * rest[j]
            out[i, j] = out[j, i] = _rounded(exact, n * n)
    return out


def _rounded(a, b):
    """``a / b`` in extended precision: the nearest double plus the nearest of what is left."""
    high = float(Fraction(a, b))
    return np.longdouble(high) + np.longdouble(float(Fraction(a, b) - Fraction(high)))


def eigenvectors(v, rounds=ROUNDS):
    """``(values, vectors)``, values falling, refined from float32 to double precision."""
    v = np.asarray(v, np.longdouble)
    d = len(v)
    size = np.abs(v).max(initial=0)
    if not size:
        return np.zeros(d), np.eye(d)
    a = v / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    last = np.inf
    for _ in range(rounds):
        values, x, change = _refine(a, x)
        if change < 4e-17 or (change < 1e-12 and change >= last):
            break
        last = change
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return (values[order] * size).astype(np.float64), x.astype(np.float64)


def _refine(a, x):
    """One iteration: ``(values, vectors, largest correction)``."""
    eye = np.eye(len(a), dtype=np.longdouble)
    r = eye - x.T @ x
    s = x.T @ a @ x
    s, r = (s + s.T) / 2, (r + r.T) / 2  # rounding must not turn two close vectors apart
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    close = 2 * (np.linalg.norm(off.astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float)))
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > close
    np.fill_diagonal(apart, False)
    safe = np.where(apart, gaps, 1)
    e = np.where(apart, (s + values[None, :] * r) / safe, r / 2)
    x = x + x @ e
    # neighbours in order of value that are not apart, solved again within their own span
    order = np.argsort(values)
    joined = np.diff(values[order]) <= close
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and joined[end - 1]:
            end += 1
        if end - at > 1:
            x[:, order[at:end]] = _solve_within(a, x[:, order[at:end]])
        at = end
    return values, x, float(np.abs(e).max())


def _solve_within(a, span):
    """Eigenvectors of ``a`` within the span of nearly equal ones, shifted by their mean value."""
    q = span
    for _ in range(2):  # Gram-Schmidt in extended precision, twice
        for i in range(q.shape[1]):
            q[:, i] -= q[:, :i] @ (q[:, :i].T @ q[:, i])
            q[:, i] /= np.sqrt((q[:, i] ** 2).sum())
    aq = a @ q
    shift = (q * aq).sum() / q.shape[1]
    small = q.T @ (aq - shift * q)
    small = (small + small.T) / 2
    size = np.abs(small).max()
    if not size:
        return q
    # scaled up, the differences within the cluster are no longer small
    _, turn = np.linalg.eigh((small / size).astype(np.float64))
    return q @ turn.astype(np.longdouble)


def fit(rows, components=COMPONENTS):
    """Model of ``rows(vec_id, x)``; None without any."""
    lengths = [r[0] for r in rows.select(F.size("x")).distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError("vectors of different lengths")
    if not lengths or not lengths[0]:
        return None
    n, *sums = _total(rows, _sums)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    products = _total(rows, _products(centre))
    v = covariance(n, sums, centre, products)
    values, vectors = eigenvectors(v)
    trace = float(np.trace(v))
    keep = [i for i in range(len(values)) if values[i] > RANK * trace][:components]
    return Model(n, sums, values[keep], vectors[:, keep], trace)


def _projected(model, x):
    """``x - S / n`` on the components, over the roots of their eigenvalues."""
    centre = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([float(Fraction(s % model.n, model.n)) for s in model.sums])
    return (((x - centre).astype(np.float64) - rest) @ model.vectors) / np.sqrt(model.values)


def _deviation(model, x):
    """Exact ``sum((n * x - S) ** 2)`` of each row; null beyond a long."""
    most = max((abs(s) for s in model.sums), default=0) + model.n * int(np.abs(x).max(initial=0))
    if most < 1 << 62:
        z = model.n * x - np.array(model.sums, np.int64)
        if int(np.abs(z).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return (z * z).sum(axis=1).tolist()
    z = model.n * x.astype(object) - np.array(model.sums, object)
    return [int(s) if s < 1 << 63 else None for s in (z * z).sum(axis=1)]


def _moments(model):
    """Count, sums and products of the whitened rows, centred on their mean, which is 0."""
    def run(batches):
        k = len(model.values)
        total = np.zeros(k + k * k)
        for batch in batches:
            w = _projected(model, _matrix(batch))
            total += np.concatenate([w.sum(axis=0), (w.T @ w).reshape(-1)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total))), pa.array(total)], ["i", "value"]
        )

    return run


def identity_error(rows, model):
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    k = len(model.values)
    parts = rows.mapInArrow(_moments(model), "i long, value double")
    total = np.zeros(k + k * k)
    for row in parts.groupBy("i").agg(F.sum("value").alias("value")).collect():
        total[row["i"]] = row["value"]
    mean, square = total[:k] / model.n, total[k:].reshape(k, k) / model.n
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def _whiten(model):
    def run(batches):
        k = len(model.values)
        for batch in batches:
            x = _matrix(batch)
            w, rows = _projected(model, x), np.repeat(np.arange(len(x)), k)
            deviation = pa.array(_deviation(model, x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"].take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), model.n)),
                    deviation.take(pa.array(rows)), pa.array(w.reshape(-1)),
                    pa.array(np.tile(model.values / model.trace, len(x))),
                ],
                [part.split()[0] for part in WHITE.split(", ")],
            )

    return run


def whiten(embeddings, components=COMPONENTS):
    """One row per remaining vector and component, see the module's docstring."""
    rows = fit_rows(embeddings)
    model = fit(rows, components)
    if model is None:
        return rows.limit(0).select(
            *(F.lit(None).cast(kind).alias(name) for name, kind in map(str.split, WHITE.split(", "))),
            F.lit(None).cast("double").alias("identity_error"),
        )
    error = F.lit(identity_error(rows, model))
    return rows.mapInArrow(_whiten(model), WHITE).withColumn("identity_error", error)


def op12_whitening(spark, sf_dir):
    return whiten(load(spark, sf_dir, "embeddings"))
