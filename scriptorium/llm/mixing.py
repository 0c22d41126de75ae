"""Document rates that bring soft domain totals to target weights.

1. A classifier learns domains from a labelled table: class means and one shared covariance of text
   statistics and byte shares, summed per partition (linear discriminant). Every document gets a
   probability for each domain, whatever its source says.
2. A document of n tokens with probabilities p, taken at rate r >= 0, adds ``r * n * p`` to
   the expected domain totals. Rates start at 1 and follow a projected gradient of the
   squared gap between totals and targets, in the metric where its curvature over the rows that
   may move is one: ``r = max(0, r - p . M^-1 (totals - targets))`` with ``M = sum(n p p')`` over
   the rows whose rate is above 0 or is asked to rise. A pass tries that step, the plain gradient and
   halvings of both and keeps the best. It ends when the totals are ``CLOSE`` to the targets or at the
   least squares point; ``target_gap`` is the share of tokens that is left off target. An
   iteration is two passes over a narrow table that return K * K and 16 K numbers for K domains; a
   document's rate is the fold of the steps so far, so no state is kept or exchanged.
3. ``copies`` is the rate rounded up or down by a hash of the id, so that its mean is the rate.

Edge cases: null or empty text has no tokens, a rate of its own and no weight in totals; rows
of one doc_id each count; rows without id are rated, and rounded like equal ids; labels of
unknown documents and null domains are not used; domains without target get weight 0,
targets without domain are left out and the others scaled up; without any labelled document all
rates are 1 and ``target_gap`` is null. An empty table gives an empty one.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scriptorium.llm.statistics import byte_histogram, statistics
from scriptorium.llm.tables import load, staged
from scriptorium.llm.words import lowered, pieces, text_bytes

SAMPLE = 20_000
SHRINK = 1e-2
CLOSE = 1e-4
# halvings of a step that one pass tries, and the least fall of the squared gap that is progress
TRIES = 8
STALLED = 1e-6

#: weights of domains by language and quality
TARGETS = {
    "en-1": 0.45, "de-1": 0.18, "fr-1": 0.18, "es-1": 0.12,
    "en-0": 0.03, "de-0": 0.015, "fr-0": 0.015, "es-0": 0.01,
}


def features(column):
    """``(one row of numbers, number of words)`` per text."""
    x = statistics(column)
    data, offsets = text_bytes(column)
    shares = byte_histogram(lowered(data), offsets)
    shares = np.sqrt(shares / np.maximum(shares.sum(axis=1, keepdims=True), 1))
    return np.concatenate([x, shares], axis=1), np.rint(np.expm1(x[:, 0]))


@dataclass
class Classifier:
    domains: list = field(default_factory=list)
    weights: np.ndarray = None
    bias: np.ndarray = None

    def posteriors(self, x):
        if len(self.domains) < 2:
            return np.ones((len(x), len(self.domains)))
        logits = x @ self.weights + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _class_sums(domains):
    place = {d: i for i, d in enumerate(domains)}

    def run(batches):
        counts = sums = squares = None
        for batch in pieces(batches):
            x, _ = features(batch["text"])
            of = np.array([place[d] for d in batch["domain"].to_pylist()])
            if sums is None:
                counts = np.zeros(len(domains))
                sums = np.zeros((len(domains), x.shape[1]))
                squares = np.zeros((x.shape[1], x.shape[1]))
            counts += np.bincount(of, minlength=len(domains))
            np.add.at(sums, of, x)
            squares += x.T @ x
        if sums is not None:
            yield pa.RecordBatch.from_pydict({
                "counts": [counts.tobytes()], "sums": [sums.tobytes()],
                "squares": [squares.tobytes()],
            })

    return run


def _added(rows):
    total = None
    for row in rows.toLocalIterator():
        parts = [np.frombuffer(row[c]).copy() for c in ("counts", "sums", "squares")]
        total = parts if total is None else [a + b for a, b in zip(total, parts)]
    return total


def fit_classifier(docs, domains, sample=SAMPLE):
    """From ``domains(doc_id, domain)``; at most ``sample`` documents by hash of the id."""
    marked = (
        domains.select(F.col("doc_id").cast("long"), F.col("domain").cast("string"))
        .where("doc_id is not null and domain is not null")
        .groupBy("doc_id").agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    marked = staged(marked, "domains")
    names = sorted(r["domain"] for r in marked.select("domain").distinct().collect())
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = texts.join(F.broadcast(marked), "doc_id").select("text", "domain")
    # few rows in few partitions, each of which returns one sum
    total = _added(
        rows.repartition(8).mapInArrow(
            _class_sums(names), "counts binary, sums binary, squares binary"
        )
    ) if names else None
    if total is None:
        return Classifier()
    counts = total[0]
    width = len(total[1]) // len(names)
    means = total[1].reshape(len(names), width) / np.maximum(counts, 1)[:, None]
    spread = total[2].reshape(width, width) / counts.sum() - (means.T * (counts / counts.sum())) @ means
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-12))
    shared = spread / np.outer(scale, scale) + SHRINK * np.eye(width)
    unit = means / scale
    weights = np.linalg.solve(shared, unit.T)
    bias = np.log(np.maximum(counts, 0.5) / counts.sum()) - 0.5 * (unit.T * weights).sum(axis=0)
    return Classifier(names, weights / scale[:, None], bias)


def _memberships(classifier):
    def run(batches):
        for batch in pieces(batches):
            x, n = features(batch["text"])
            p = classifier.posteriors(x)
            edges = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(n), pa.ListArray.from_arrays(edges, pa.array(p.reshape(-1)))], ["n", "p"]
            )

    return run


def rates(p, steps):
    """Fold of the gradient steps for rows of probabilities.

    A step is a gap and a direction. Rows at 0 stay there unless the gap asks for more of them.
    """
    r = np.ones(len(p))
    for gap, direction in steps:
        free = (r > 0) | (p @ gap < 0)
        r = np.where(free, np.maximum(0.0, r - p @ direction), 0.0)
    return r


def _totals(k, steps, tries):
    """Totals after each of the tries, in one pass."""
    def run(batches):
        sums = np.zeros((len(tries), k))
        for batch in batches:
            n = np.asarray(batch["n"])
            p = np.asarray(batch["p"].flatten()).reshape(-1, k)
            for i, step in enumerate(tries):
                sums[i] += (n * rates(p, [*steps, step])) @ p
        yield _numbered(sums)

    return run


def _curvature(k, steps, gap):
    """``sum(n p p')`` over the rows that the next step may move."""
    def run(batches):
        squares = np.zeros((k, k))
        for batch in batches:
            n = np.asarray(batch["n"])
            p = np.asarray(batch["p"].flatten()).reshape(-1, k)
            moved = p[free] if not (free := (rates(p, steps) > 0) | (p @ gap < 0)).all() else p
            squares += (moved * n[free][:, None]).T @ moved
        yield _numbered(squares)

    return run


def _numbered(values):
    flat = values.reshape(-1)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "value"])


def _sum(table, run, shape):
    """Partition sums added up: as many numbers as ``shape`` holds."""
    parts = table.mapInArrow(run, "i long, value double")
    out = np.zeros(int(np.prod(shape)))
    for row in parts.groupBy("i").agg(F.sum("value").alias("value")).collect():
        out[row["i"]] = row["value"]
    return out.reshape(shape)


def solve_rates(docs, classifier, targets=TARGETS, close=CLOSE):
    """``(steps, gap)``: gradient steps to the targets and the share of tokens still off them.

    Ends when the gap is ``close``, or when no row can move downhill any further: the least
    squares point, with the targets out of reach by ``gap``.
    """
    k = len(classifier.domains)
    if not k:
        return [], None
    table = staged(
        docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
            _memberships(classifier), "n double, p array<double>"
        ), "memberships",
    )
    nothing = (np.zeros(k), np.zeros(k))
    totals = _sum(table, _totals(k, [], [nothing]), (1, k))[0]
    weights = np.array([targets.get(d, 0.0) for d in classifier.domains])
    if not weights.sum() or not totals.sum():
        return [], None
    size = totals.sum()
    wanted = weights / weights.sum() * size
    steps = []
    while (off := np.abs(totals - wanted).sum() / size) > close:
        gap = totals - wanted
        squares = _sum(table, _curvature(k, steps, gap), (k, k))
        slope = squares @ gap
        newton = np.linalg.pinv(squares, rcond=1e-12, hermitian=True) @ gap
        # the exact minimum along the plain gradient, were no rate to reach 0
        gradient = gap * (gap @ slope) / max(slope @ slope, 1e-300)
        tries = [(gap, d * 0.5**i) for d in (newton, gradient) for i in range(TRIES)]
        reached = _sum(table, _totals(k, steps, tries), (len(tries), k))
        losses = ((reached - wanted) ** 2).sum(axis=1)
        best = int(np.argmin(losses))
        if losses[best] >= (1 - STALLED) * (gap @ gap):
            break
        steps.append(tries[best])
        totals = reached[best]
    return steps, float(off)


def fit_rates(docs, classifier, targets=TARGETS, close=CLOSE):
    """Gradient steps that bring the expected totals of ``docs`` to the targets."""
    return solve_rates(docs, classifier, targets, close)[0]


ADDED = (
    "n_tokens long, domain string, probability double, rate double, copies long, "
    "target_gap double"
)
NAMES = [part.split()[0] for part in ADDED.split(", ")]


def _rate(classifier, steps, gap):
    def run(batches):
        for batch in pieces(batches):
            if classifier.domains:
                x, n = features(batch["text"])
                p = classifier.posteriors(x)
                r, sure = rates(p, steps), p.max(axis=1)
                best = [classifier.domains[i] for i in p.argmax(axis=1)]
            else:
                n = np.rint(np.expm1(statistics(batch["text"])[:, 0]))
                r, sure, best = np.ones(len(n)), np.zeros(len(n)), [None] * len(n)
            copies = np.floor(r) + (np.asarray(batch["_draw"]) < r - np.floor(r))
            own = [c for c in batch.schema.names if c != "_draw"]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in own), pa.array(n.astype(np.int64)), pa.array(best, pa.string()),
                 pa.array(sure), pa.array(r), pa.array(copies.astype(np.int64)),
                 pa.array([gap] * len(n), pa.float64())],
                [*own, *NAMES],
            )

    return run


def rated(docs, classifier, steps, gap=None):
    """``docs`` with tokens, likeliest domain, rate, copies and the gap left to the targets.

    Columns of those names give way.
    """
    docs = docs.select(*(c for c in docs.columns if c not in NAMES))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 20)) / float(1 << 20)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn("_draw", draw).mapInArrow(_rate(classifier, steps, gap), f"{own}, {ADDED}")


def mix(docs, domains, targets=TARGETS, sample=SAMPLE):
    """``docs`` with rates whose expected domain totals match ``targets``."""
    classifier = fit_classifier(docs, domains, sample)
    return rated(docs, classifier, *solve_rates(docs, classifier, targets))


def language_quality(docs, labels):
    """Labelled table of domains: language and quality mark of labelled documents."""
    marks = labels.select(F.col("doc_id").alias("_of"), "quality").where("quality in (0, 1)")
    return docs.select("doc_id", "lang").join(marks, F.col("doc_id") == F.col("_of")).select(
        "doc_id", F.concat_ws("-", "lang", "quality").alias("domain")
    )


def op6_mixing(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    domains = language_quality(docs, load(spark, sf_dir, "labels"))
    return mix(docs.select("doc_id", "source", "text"), domains).drop("text")
