"""Toxic passages as maximum-scoring segments of token log-odds.

Fit, from labelled rows of a bounded sample:

* Tokens are counted once per document with their prefixes of 4 to 10 bytes, so that word
  families count too. The share of a token's documents that are toxic has a Dirichlet prior
  centred on the share of the next shorter prefix, and of the corpus at last. The token's
  score is the log-odds of that posterior against the corpus share. The ``LEXICON`` counts
  that differ most from the corpus share are kept; a word without any scores ``REST``.
* A linear scan finds all maximal scoring segments (passages whose score no longer or shorter
  one beats). By extreme-value theory the best score of n random tokens exceeds S with
  expectation K * n * exp(-lambda * S): lambda solves ``mean(exp(lambda * score)) = 1`` over
  tokens of clean documents, K is its maximum-likelihood value on them.
* Passages with expectation up to ``SIGNIFICANT`` are toxic. Their evidence
  ``-ln(expectation)`` in a document is turned into a probability by logistic calibration on
  labelled rows that were not counted.

Scoring is one pass over the texts without any exchange. The broadcast model has at most
``LEXICON`` entries of 24 bytes.

Edge cases: null or empty text has no words and scores like a text without toxic passages.
Rows of one doc_id are scored one by one. Labels that are null are not used; several labels
of one document count as toxic if one is. Without both labels in the training rows every score is
the share of toxic ones, 0 without any. An empty table gives an empty one.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from scriptorium.llm.tables import fold, labelled, load, remainder
from scriptorium.llm.words import (
    NO_LETTER, U64, lowered, mix, pieces, span_hashes, text_bytes, word_spans,
)

PREFIXES = (4, 5, 6, 7, 8, 9, 10)
SAMPLE = 20_000
LEXICON = 100_000
LEAST_DOCS = 5
LEAST_Z = 4.0
PRIOR = 4.0
REST = -0.3
SIGNIFICANT = 0.05


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    docs: np.ndarray = field(default_factory=lambda: np.zeros(0))
    share: float = 0.0
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 0.0
    bias: float = 0.0


def _families(column):
    """``(text of each word, first, keys)``; keys are those of each prefix and of the word.

    A prefix key is 0 where the word is not longer than the prefix.
    """
    data, offsets = text_bytes(column)
    data = lowered(data)
    starts, ends, first = word_spans(data, offsets, NO_LETTER)
    keys = []
    for length in PREFIXES:
        long = np.flatnonzero(ends - starts > length)
        key = np.zeros(len(starts), U64)
        key[long] = span_hashes(data, starts[long], starts[long] + length) + U64(length)
        keys.append(key)
    keys.append(span_hashes(data, starts, ends))
    return np.repeat(np.arange(len(first) - 1), np.diff(first)), first, keys


def _count(batches):
    for batch in pieces(batches, size=2 << 20):
        text, _, families = _families(batch["text"])
        toxic = np.asarray(batch["toxic"], np.float64)
        columns = [], [], []
        for family in families:
            _, one = np.unique(mix(family + mix(text.astype(U64))), return_index=True)
            one = one[family[one] != 0]
            keys, index = np.unique(family[one], return_inverse=True)
            columns[0].append(keys.view(np.int64))
            columns[1].append(np.bincount(index, minlength=len(keys)))
            columns[2].append(np.bincount(index, toxic[text[one]], len(keys)).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c)) for c in columns], ["key", "docs", "toxic"]
        )


def _token_scores(model, column):
    """``(first, score of every token)`` of a text column."""
    text, first, families = _families(column)
    words, one, index = np.unique(families[-1], return_index=True, return_inverse=True)
    share = np.full(len(words), model.share)
    known = np.zeros(len(words), bool)
    if len(model.keys):
        for family in families:
            key = family[one]
            at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
            hit = (model.keys[at] == key) & (key != 0)
            posterior = (model.toxic[at] + PRIOR * share) / (model.docs[at] + PRIOR)
            share = np.where(hit, posterior, share)
            known |= hit
    odds = np.log(share / (1 - share)) if 0 < model.share < 1 else np.zeros(len(words))
    base = np.log(model.share / (1 - model.share)) if 0 < model.share < 1 else 0.0
    scores = np.where(known, odds - base, 0.0) + REST
    return first, scores[index]


def segments(scores):
    """All maximal scoring segments ``(start, end, score)`` of one sequence, in linear time.

    Only tokens above zero begin or end one, so the scan jumps between them. Each candidate
    keeps the cumulative score left and right of it, and a link to the nearest candidate before
    it with a smaller left score.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    left, right, start, end, before = [], [], [], [], []
    for at in np.flatnonzero(scores > 0).tolist():
        low, high, begin = float(total[at]), float(total[at + 1]), at
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = before[j]
            if j < 0 or right[j] >= high:
                break
            low, begin = left[j], start[j]
            del left[j:], right[j:], start[j:], end[j:], before[j:]
            j -= 1
        left.append(low)
        right.append(high)
        start.append(begin)
        end.append(at + 1)
        before.append(j)
    return [(s, e, r - x) for s, e, r, x in zip(start, end, right, left)]


def _evidence(model, found, n):
    """Segments with their evidence ``-ln(expectation)`` in a text of n tokens."""
    size = np.log(max(model.scale * n, 1e-9))
    return [(s, e, model.rate * score - size) for s, e, score in found]


def _calibration_rows(model):
    def run(batches):
        for batch in pieces(batches):
            first, scores = _token_scores(model, batch["text"])
            found, marked = [], []
            for a, b in zip(first[:-1], first[1:]):
                own = scores[a:b]
                found.append([s for _, _, s in segments(own)])
                marked.append(own[own != REST].tolist())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch["toxic"], pa.array(np.diff(first)), pa.array(found, kind),
                 pa.array(marked, kind)],
                ["toxic", "n", "found", "scores"],
            )

    return run


def _gumbel(rows):
    """``(lambda, K)`` from clean rows: the Karlin-Altschul equation, then maximum likelihood."""
    clean = rows[rows["toxic"] == 0]
    n = clean["n"].to_numpy(np.float64)
    marked = np.concatenate([np.zeros(0), *(np.asarray(s, float) for s in clean["scores"])])
    rest = n.sum() - len(marked)
    if not n.sum() or not (marked > 0).any():
        return 1.0, 1.0
    low, high = 1e-6, 64.0
    for _ in range(100):
        middle = (low + high) / 2
        mean = (rest * np.exp(middle * REST) + np.exp(np.minimum(middle * marked, 600)).sum()) / n.sum()
        low, high = (middle, high) if mean < 1 else (low, middle)
    rate = min(max(low, 0.1), 8.0)
    best = np.array([max(found, default=0.0) for found in clean["found"]])
    scale = len(n) / max(float((n * np.exp(-rate * best)).sum()), 1e-9)
    return rate, scale


def _logistic(x, y, steps=50, ridge=1e-3):
    """Slope and intercept by Newton's method."""
    design = np.stack([x, np.ones(len(x))], axis=1)
    weights = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -40, 40)))
        slope = design.T @ (p - y) + ridge * weights
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curve, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def _document(model, evidence):
    """One number per document: the evidence of its significant passages, or of the best."""
    strong = [e for _, _, e in evidence if e >= -np.log(SIGNIFICANT)]
    return float(np.clip(sum(strong) if strong else max((e for *_, e in evidence), default=-20.0), -20, 60))


def fit(docs, labels, sample=SAMPLE, lexicon=LEXICON):
    """Model from ``labels(doc_id, toxic)``; at most ``sample`` documents by hash of the id."""
    marked = labelled(labels, "toxic", sample).withColumnRenamed("label", "toxic")
    counted = fold() != 0
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(
        F.broadcast(marked), "doc_id"
    )
    learn = rows.where(counted)
    sizes = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    n, t = sum(sizes.values()), sizes.get(1, 0)
    if not n or not 0 < t < n:
        return Model(share=t / n if n else 0.0)
    model = Model(share=t / n)
    p = F.lit(model.share)
    counts = (
        learn.select("text", "toxic").mapInArrow(_count, "key long, docs long, toxic long")
        .groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
        .where(F.col("docs") >= LEAST_DOCS)
        .withColumn("z", F.abs(F.col("toxic") - F.col("docs") * p) / F.sqrt(F.col("docs") * p * (1 - p)))
        .where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "key").limit(lexicon).toPandas()
    )
    keys = counts["key"].to_numpy(np.int64).view(U64)
    order = np.argsort(keys)
    model.keys = keys[order]
    model.toxic = counts["toxic"].to_numpy(np.float64)[order]
    model.docs = counts["docs"].to_numpy(np.float64)[order]
    held = rows.where(~counted).select("text", "toxic").mapInArrow(
        _calibration_rows(model), "toxic int, n long, found array<double>, scores array<double>"
    ).toPandas()
    if held["toxic"].nunique() < 2:
        return model
    model.rate, model.scale = _gumbel(held)
    x = [
        _document(model, _evidence(model, [(0, 0, s) for s in found], n))
        for found, n in zip(held["found"], held["n"])
    ]
    model.slope, model.bias = _logistic(np.array(x), held["toxic"].to_numpy(np.float64))
    return model


SCORES = (
    "doc_id long, n_tokens long, score double, "
    "passages array<struct<start:int,end:int,evidence:double>>"
)


PASSAGE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())])


def _scored(model, batch):
    """``SCORES`` of one batch."""
    first, scores = _token_scores(model, batch["text"])
    least = -np.log(SIGNIFICANT)
    out, passages = [], []
    for a, b in zip(first[:-1], first[1:]):
        evidence = _evidence(model, segments(scores[a:b]), b - a)
        x = model.slope * _document(model, evidence) + model.bias
        out.append(float(1 / (1 + np.exp(-np.clip(x, -40, 40)))) if model.slope else model.share)
        passages.append(
            [{"start": s, "end": e, "evidence": v} for s, e, v in evidence if v >= least]
        )
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"], pa.array(np.diff(first)), pa.array(out, pa.float64()),
         pa.array(passages, pa.list_(PASSAGE))],
        ["doc_id", "n_tokens", "score", "passages"],
    )


def _score(model):
    def run(batches):
        for batch in pieces(batches):
            yield _scored(model, batch)

    return run


def toxicity(docs, model):
    """``(doc_id, n_tokens, score, passages)``; a passage is a range of words."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(_score(model), SCORES)


def training_labels(labels):
    return labels.where(remainder(5) != 0)


def _keep(model, threshold):
    def run(batches):
        for batch in pieces(batches):
            yield batch.filter(pc.less(_scored(model, batch)["score"], threshold))

    return run


def drop_toxic(docs, labels, threshold=0.5):
    """``docs`` without the rows that score ``threshold`` or more."""
    return docs.mapInArrow(_keep(fit(docs, labels), threshold), docs.schema)


def op2_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    model = fit(docs, training_labels(load(spark, sf_dir, "labels")))
    return toxicity(docs, model).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_tokens", "passages",
    )
