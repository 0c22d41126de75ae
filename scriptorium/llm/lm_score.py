"""Log probability of documents under a subword lattice with the corpus's words as extra arcs.

The pieces of an existing vocabulary weight all segmentations of a word; four rounds of
expectation maximisation over the distinct words of the training documents adapt the weights,
with the vocabulary's own as prior. A word counted c > 0 times in N training tokens is also an
arc of its own, with absolute discount d (from the numbers of words seen once and twice):

    P(word) = max(c - d, 0) / N + d * V / N * lattice(word),    P(end) = ends / N

which adds up to one over all words and the end of text. A document's score is the sum of
the logarithms over its words and its end.

Counting is one keyed sum of distinct words. Scoring takes the ``HEAD`` most frequent words from a
small broadcast table inside the tasks; only the rest, once per document and word, is joined with
the word table. No group is ever gathered: both exchanges feed sums.

Edge cases: null text is empty and has its end only. Rows of one doc_id are one document, whose
tokens add up, ends included. Without training documents N is 0, base scores are those of
the formula, and the lattice alone scores with an even chance to end. An empty table gives an
empty one.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scriptorium.llm import lattice as lat
from scriptorium.llm.tables import load, remainder, staged
from scriptorium.llm.words import (
    U64, lowered, mix, pieces, span_hashes, text_bytes, word_spans,
)

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROUNDS = 4
HEAD = 100_000
# no word holds a blank, so this stands for the end of a text
END = " "
HELD_ROWS = 400_000


def _gather(data, starts, ends):
    """Arrow string column of the spans."""
    sizes = ends - starts
    edges = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - edges[:-1], sizes) + np.arange(edges[-1])
    return pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data[at])
    )


def _hashed(column):
    data, offsets = text_bytes(column)
    data = lowered(data)
    starts, ends, first = word_spans(data, offsets)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return data, starts, ends, text, span_hashes(data, starts, ends)


def _summed(tables):
    return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])


def _count(batches):
    """Words of this task's texts with their count in training texts."""
    held = []
    for batch in pieces(batches):
        training = np.asarray(batch["training"].cast(pa.int64()))
        data, starts, ends, text, hashes = _hashed(batch["text"])
        _, one, index = np.unique(hashes, return_index=True, return_inverse=True)
        n = np.bincount(index, training[text], len(one)).astype(np.int64)
        held.append(pa.table({"word": _gather(data, starts[one], ends[one]), "n": n}))
        held.append(pa.table({"word": [END], "n": [int(training.sum())]}))
        if sum(len(t) for t in held) > HELD_ROWS:
            held = [_summed(held)]
            if len(held[0]) > HELD_ROWS // 2:
                yield from held[0].to_batches()
                held = []
    if held:
        yield from _summed(held).to_batches()


def word_counts(docs):
    """``(word, c)`` of all documents' words; c counts ``training`` ones. The end is a word too."""
    counted = docs.select("text", "training").mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("c"))


def _uses(lattice):
    def run(batches):
        uses = np.zeros(len(lattice.weights))
        for batch in batches:
            words = lat.words_of(batch["word"])
            uses += lat.expected_uses(lattice, words, np.ones(len(words)))[0]
        used = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(uses[used])], ["node", "uses"])

    return run


def adapted(lattice, counts, words, rounds=ROUNDS):
    """The lattice after expectation maximisation over the distinct words counted."""
    trained = counts.where((F.col("c") > 0) & (F.col("word") != END)).select("word")
    finite = np.isfinite(lattice.weights)
    prior = np.where(finite, np.exp(lattice.weights), 0.0) * finite.sum() / 2
    for _ in range(rounds if words else 0):
        rows = (
            trained.mapInArrow(_uses(lattice), "node long, uses double")
            .groupBy("node").agg(F.sum("uses").alias("uses")).collect()  # vocabulary-sized
        )
        uses = prior.copy()
        for row in rows:
            uses[row["node"]] += row["uses"]
        stop = words / (words + uses[~lattice.begins].sum())
        lattice = lat.normalised(lattice.edges, lattice.begins, uses, stop)
    return lattice


def _word_scores(lattice, total, discount, distinct):
    """Adds log10 P(word) to ``(word, c)``."""
    def run(batches):
        for batch in batches:
            c = np.asarray(batch["c"], np.float64)
            words = lat.words_of(batch["word"])
            log_whole = lat.log_probabilities(lattice, words)
            ends = np.array([w == END.encode() for w in words])
            with np.errstate(divide="ignore"):
                if total:
                    own = np.log(np.maximum(c - discount, 0) / total)
                    score = np.logaddexp(own, np.log(discount * distinct / total) + log_whole)
                    score = np.where(ends, np.log(np.maximum(c, 0.5) / total), score)
                else:
                    score = np.log(0.5) + np.where(ends, 0.0, log_whole)
            yield pa.RecordBatch.from_arrays(
                [batch["word"], batch["c"], pa.array(score / np.log(10))], ["word", "c", "score"]
            )

    return run


PARTS = (
    "doc_id long, held_out boolean, word string, n long, "
    "n_tokens long, n_known long, base_score double, score double"
)


def _parts(head):
    """Per document the sums over head words, and a row for each other word of it."""
    def run(batches):
        for batch in pieces(batches):
            docs = batch.num_rows
            data, starts, ends, text, hashes = _hashed(batch["text"])
            at = np.minimum(np.searchsorted(head["key"], hashes), len(head["key"]) - 1)
            hit = head["key"][at] == hashes
            sums = [
                np.bincount(text[hit], head[name][at[hit]], docs) + head["end"][name]
                for name in ("known", "base", "score")
            ]
            rest = np.flatnonzero(~hit)
            _, one, n = np.unique(
                mix(hashes[rest] + mix(text[rest].astype(U64))), return_index=True, return_counts=True
            )
            one = rest[one]
            of = np.concatenate([np.arange(docs), text[one]])
            zeros = np.zeros(len(one))
            # a key of its own for each document's sums, which no word can equal
            own = pa.array([f" {i}" for i in batch["doc_id"].to_pylist()], pa.string())
            word = pa.concat_arrays([own, _gather(data, starts[one], ends[one])])
            tokens = np.bincount(text, minlength=docs) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(of)), batch["held_out"].take(pa.array(of)), word,
                    pa.array(np.concatenate([np.zeros(docs, np.int64), n])),
                    pa.array(np.concatenate([tokens, zeros.astype(np.int64)])),
                    pa.array(np.concatenate([sums[0], zeros]).astype(np.int64)),
                    pa.array(np.concatenate([sums[1], zeros])),
                    pa.array(np.concatenate([sums[2], zeros])),
                ],
                ["doc_id", "held_out", "word", "n", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def _level(c):
    """Frequency class of a count; at most some 500 of them."""
    return F.floor(F.log2(F.greatest(c, F.lit(1))) * 8)


def _head(words, size):
    """At most ``size`` words, all those of the highest frequency classes, by hash.

    Returns them with the sums that one occurrence adds, and the lowest class taken.
    """
    counted = words.where((F.col("word") != END) & (F.col("c") > 0)).withColumn("level", _level(F.col("c")))
    taken, lowest = 0, 1 << 20
    for row in sorted(counted.groupBy("level").count().collect(), reverse=True):
        taken += row["count"]
        if taken > size:
            break
        lowest = row["level"]
    end = words.where(F.col("word") == END).toPandas()
    rows = counted.where(F.col("level") >= lowest).drop("level").toPandas()
    data, offsets = text_bytes(pa.array(rows["word"].tolist(), pa.string()))
    keys = span_hashes(data, offsets[:-1], offsets[1:])
    order = np.argsort(keys)
    head = {"key": np.append(keys[order], U64(2**64 - 1))}
    for name in ("known", "base", "score"):
        head[name] = np.append(rows[name].to_numpy(np.float64)[order], 0.0)
    head["end"] = {name: float(end[name].sum()) for name in ("known", "base", "score")}
    return head, lowest


def lm_scores(docs, vocabulary=VOCABULARY, rounds=ROUNDS, head=HEAD):
    """Scores of ``docs(doc_id, text, training, held_out)``, one row per doc_id."""
    counts = staged(word_counts(docs), "words")
    row = counts.select(
        F.coalesce(F.sum("c"), F.lit(0)).alias("total"),
        F.count_if(F.col("c") > 0).alias("distinct"),
        F.count_if((F.col("c") > 0) & (F.col("word") != END)).alias("words"),
        F.count_if((F.col("c") == 1) & (F.col("word") != END)).alias("once"),
        F.count_if((F.col("c") == 2) & (F.col("word") != END)).alias("twice"),
    ).first()
    total, once = row["total"], max(row["once"], 1)
    discount = min(max(once / (once + 2 * row["twice"]), 0.1), 0.9)
    lattice = adapted(lat.build(lat.vocabulary(vocabulary)), counts, row["words"], rounds)
    words = staged(
        counts.mapInArrow(
            _word_scores(lattice, total, discount, row["words"]), "word string, c long, score double"
        ).select(
            "*", (F.col("c") > 0).cast("long").alias("known"),
            F.log10((F.col("c") + 1) / F.lit(float(total + row["distinct"] + 1))).alias("base"),
        ),
        "scores",
    )
    table, lowest = _head(words, head)
    rare = words.where((F.col("c") == 0) | (_level(F.col("c")) < lowest))
    parts = docs.select("doc_id", "text", "held_out").mapInArrow(_parts(table), PARTS)
    n = F.col("n")
    joined = parts.join(
        rare.select("word", "known", "base", F.col("score").alias("log_p")), "word", "left"
    )
    add = lambda own, each: F.sum(F.col(own) + F.when(n > 0, n * F.col(each)).otherwise(0))
    return joined.groupBy("doc_id").agg(
        F.first("held_out").alias("held_out"), F.sum(F.col("n_tokens")).alias("n_tokens"),
        add("n_known", "known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        add("base_score", "base").alias("base_score"), add("score", "log_p").alias("score"),
    )


def op9_lm_score(spark, sf_dir):
    held_out = F.coalesce(remainder(7) == 2, F.lit(False))
    docs = load(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out.alias("held_out"),
        (~held_out).alias("training"),
    )
    return lm_scores(docs)
