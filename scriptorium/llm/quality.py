"""Quality score: kernel ridge on document statistics by random Fourier features.

Statistics are standardised and mapped to ``FEATURES`` random cosines, whose inner products
approximate a Gaussian kernel. Each partition of the labelled rows sums its part of the normal
equations, so the driver adds a few small matrices and solves once. The ridge score is then
turned into a probability by isotonic calibration on labelled rows left out of the sums. Scoring
is one pass without any exchange, with a model of a few hundred kilobytes.

Edge cases: null or empty text has statistics of zero and gets their score; rows of one doc_id are
scored one by one; null labels are not used, and of several labels the larger one counts;
with one label only, every score is that label, and 0 without any. An empty table gives an
empty one.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scriptorium.llm.statistics import NAMES, statistics
from scriptorium.llm.tables import fold, labelled, load, remainder
from scriptorium.llm.words import pieces

SAMPLE = 20_000
FEATURES = 256
WIDTH = 4.0
RIDGE = 1e-3
SEED = 7
SUMS = 8


@dataclass
class Model:
    mean: np.ndarray = None
    spread: np.ndarray = None
    directions: np.ndarray = None
    shifts: np.ndarray = None
    weights: np.ndarray = None
    knots: np.ndarray = None
    levels: np.ndarray = None
    constant: float = None

    def features(self, x):
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        waves = np.sqrt(2 / len(self.shifts)) * np.cos(x @ self.directions + self.shifts)
        return np.concatenate([waves, np.ones((len(x), 1))], axis=1)

    def raw(self, x):
        return self.features(x) @ self.weights

    def score(self, x):
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.interp(self.raw(x), self.knots, self.levels)


def _vectors(batches):
    for batch in pieces(batches):
        x = statistics(batch["text"])
        edges = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
        yield pa.RecordBatch.from_arrays(
            [batch["label"], batch["fitted"],
             pa.ListArray.from_arrays(edges, pa.array(x.reshape(-1)))],
            ["label", "fitted", "x"],
        )


def _matrix(column, width):
    return np.asarray(column.flatten()).reshape(-1, width)


def _partial_sums(model):
    """Sums of ``ZᵀZ`` and ``Zᵀy`` over the rows of one partition."""
    def run(batches):
        n = len(model.shifts) + 1
        gram, target = np.zeros((n, n)), np.zeros(n)
        for batch in batches:
            z = model.features(_matrix(batch["x"], len(NAMES)))
            gram += z.T @ z
            target += z.T @ np.asarray(batch["label"], np.float64)
        yield pa.RecordBatch.from_pydict({"gram": [gram.tobytes()], "target": [target.tobytes()]})

    return run


def isotonic(x, y):
    """Knots and levels of the rising step fit (pool adjacent violators), joined linearly."""
    # equal x are one point with their mean before anything is pooled
    points, place, counts = np.unique(x, return_inverse=True, return_counts=True)
    sums = np.bincount(place, np.asarray(y, np.float64), len(points))
    pools = []
    for point, total, count in zip(points.tolist(), sums.tolist(), counts.tolist()):
        pools.append([point, point, total, count])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, end, total, count = pools.pop()
            pools[-1][1] = end
            pools[-1][2] += total
            pools[-1][3] += count
    knots, levels = [], []
    for start, end, total, count in pools:
        knots += [start, end]
        levels += [total / count] * 2
    return np.array(knots), np.array(levels)


def fit(docs, labels, sample=SAMPLE, features=FEATURES, width=WIDTH, ridge=RIDGE):
    """Model from ``labels(doc_id, quality)``; at most ``sample`` documents by hash of the id."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = texts.join(F.broadcast(labelled(labels, "quality", sample)), "doc_id")
    # at most ``sample`` short vectors: cheap to deal out again, and to keep
    rows = rows.select("text", "label", (fold() != 0).alias("fitted")).mapInArrow(
        _vectors, "label int, fitted boolean, x array<double>"
    ).repartition(SUMS).persist()
    try:
        moments = rows.select(
            F.count("*").alias("n"), F.avg("label").alias("label"),
            *(F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(len(NAMES))),
            *(F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(len(NAMES))),
        ).first()
        if not moments["n"] or moments["label"] in (0.0, 1.0):
            return Model(constant=moments["label"] or 0.0)
        random = np.random.default_rng(SEED)
        spread = np.array([moments[f"s{i}"] for i in range(len(NAMES))])
        model = Model(
            mean=np.array([moments[f"m{i}"] for i in range(len(NAMES))]),
            spread=np.where(spread > 1e-12, spread, 1.0),
            directions=random.normal(size=(len(NAMES), features)) / width,
            shifts=random.uniform(0, 2 * np.pi, features),
        )
        sums = rows.where("fitted").mapInArrow(
            _partial_sums(model), "gram binary, target binary"
        ).collect()
        gram = sum(np.frombuffer(r["gram"]) for r in sums).reshape(features + 1, features + 1)
        target = sum(np.frombuffer(r["target"]) for r in sums)
        n = max(gram[-1, -1], 1.0)
        model.weights = np.linalg.solve(gram / n + ridge * np.eye(features + 1), target / n)
        held = rows.where("not fitted").select("x", "label").toPandas()
        if len(held) == 0:
            held = rows.select("x", "label").toPandas()
        raw = model.raw(np.array(held["x"].tolist()).reshape(-1, len(NAMES)))
        model.knots, model.levels = isotonic(raw, held["label"].to_numpy())
        return model
    finally:
        rows.unpersist()


def _score(model):
    def run(batches):
        for batch in pieces(batches):
            score = model.score(statistics(batch["text"]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.clip(score, 0, 1), pa.float64())], ["doc_id", "score"]
            )

    return run


def quality(docs, model):
    """``(doc_id, score)`` per row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(_score(model), "doc_id long, score double")


def op8_quality(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = fit(docs, labels.where(remainder(4) != 2))
    return quality(docs, model).select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
