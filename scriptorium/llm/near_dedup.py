"""Near-duplicate documents: SuperMinHash signatures, banding, exact check, components.

1. Each text becomes the set of its distinct 5-word shingles (64-bit hashes), a fingerprint
   of the whole set and a signature. Documents with equal sets form a class at once, however
   many there are; only the class goes on, under its smallest doc_id.
2. Signatures are cut into bands; classes that agree in a band are candidates. A pair at the
   threshold is missed by all bands with probability ``MISSED`` at most: 4e-7 by 25 bands of 5
   slots at 0.85, 8e-8 by 31 of 4 at 0.8. Buckets of up
   to ``SMALL_BUCKET`` classes give those pairs that also agree in a 128-bit sketch; larger
   ones, which hold true near copies, give one edge per member.
3. Candidate components are cut into blocks of about ``BLOCK`` classes by the size of their sets;
   blocks whose sizes rule out the similarity are never paired. A task gets two
   blocks with their full sets and signatures, so its memory is bounded whatever the component's
   size, and counts the intersection of every pair whose signatures allow the similarity and that is
   not yet connected. It returns a spanning forest of the exact links.
4. The components of those links are the groups; the smallest doc_id of one stays.

Edge cases: null or blank text has the empty set, ``n_shingles`` 0, and is linked with
nothing. Rows of one doc_id count as one document; each row gets its answer. A row without
doc_id is linked with nothing: ``component_id`` null, kept. An empty table gives an empty one.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scriptorium.llm.blocks import BLOCK, TASK, block_pairs
from scriptorium.llm.components import connected_components
from scriptorium.llm.superminhash import signatures
from scriptorium.llm.tables import load, staged, texts_of
from scriptorium.llm.words import (
    U64, distinct, lowered, mix, pieces, shingle_hashes, text_bytes, word_hashes,
)

WIDTH = 5
SLOTS = 125
MISSED = 1e-6
SMALL_BUCKET = 32

FEATURES = (
    "doc_id long, n_shingles long, print array<long>, sketch array<long>, bands array<long>"
)


def limits(percent, slots=SLOTS):
    """``(bands, sketch bits, margin)`` that hide hardly any pair with this similarity.

    Of the sketch's bits a pair at 0.85 differs in 9 on average and in over 30 twice in 1e9, at
    0.8 in 12 and in over 36 once in 1e9: seven standard deviations. The margin is five of the
    estimate.
    """
    same = percent / 100
    rows = max(
        (r for r in range(1, slots + 1) if (1 - same**r) ** (slots // r) <= MISSED), default=1
    )
    apart = (1 - same) / 2
    sketch_bits = round(slots * apart + 7 * (slots * apart * (1 - apart)) ** 0.5)
    return slots // rows, sketch_bits, 5 * (same * (1 - same) / slots) ** 0.5


def _sets(batch, width):
    data, offsets = text_bytes(batch["text"])
    words, first, _, _ = word_hashes(lowered(data), offsets)
    return distinct(*shingle_hashes(words, first, width))


def _sums(values, first):
    """Sum of the values of each set, modulo 2**64."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
        return total[first[1:]] - total[first[:-1]]


def _lists(table):
    """Arrow list column from a two-dimensional array of 64-bit numbers."""
    flat = pa.array(np.ascontiguousarray(table).view(np.int64).reshape(-1))
    edges = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
    return pa.ListArray.from_arrays(pa.array(edges), flat)


def _sketch(table):
    """Two 64-bit words per row: one bit of the hash of every slot's value."""
    bits = (mix(table.view(U64)) & U64(1)).astype(np.uint8)
    bits = np.pad(bits, ((0, 0), (0, 128 - bits.shape[1])))
    return np.packbits(bits, axis=1).view(U64)


def _band_keys(table, bands):
    n, slots = table.shape
    rows = slots // bands
    keys = np.zeros((n, bands), U64)
    values = table[:, : rows * bands].copy().view(U64).reshape(n, bands, rows)
    with np.errstate(over="ignore"):
        for i in range(rows):
            keys = mix(keys * U64(0x9E3779B97F4A7C15) + values[:, :, i])
        return mix(keys + np.arange(1, bands + 1, dtype=U64)[None, :])


def _features(width, slots, bands):
    def run(batches):
        for batch in pieces(batches):
            values, first = _sets(batch, width)
            table = signatures(values, first, slots)
            prints = np.stack([_sums(values, first), _sums(mix(values + U64(77)), first)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], pa.array(np.diff(first)), _lists(prints),
                    _lists(_sketch(table)), _lists(_band_keys(table, bands)),
                ],
                ["doc_id", "n_shingles", "print", "sketch", "bands"],
            )

    return run


def features(docs, bands, width=WIDTH, slots=SLOTS):
    """One narrow row per document: set size, fingerprint, sketch and band keys."""
    return texts_of(docs).mapInArrow(_features(width, slots, bands), FEATURES)


def _binary(values, first):
    """Arrow binary column of the sets' 8-byte values."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(first) - 1,
        [None, pa.py_buffer((first * 8).astype(np.int64)), pa.py_buffer(values.view(np.uint8))],
    ).cast(pa.binary())


def _full_sets(width, slots):
    def run(batches):
        for batch in pieces(batches):
            values, first = _sets(batch, width)
            marks = _marks(signatures(values, first, slots)).view(np.uint8).reshape(-1)
            edges = np.arange(len(first), dtype=np.int64) * (2 * slots)
            packed = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(first) - 1, [None, pa.py_buffer(edges), pa.py_buffer(marks)]
            )
            yield pa.RecordBatch.from_arrays(
                [batch["node"], _binary(values, first), packed.cast(pa.binary())],
                ["node", "set", "marks"],
            )

    return run


def _marks(table):
    """16 bits of every slot's value: equal values stay equal."""
    return np.ascontiguousarray(mix(table.view(U64)) & U64(0xFFFF)).astype(np.uint16)


def candidate_edges(nodes, sketch_bits, small_bucket=SMALL_BUCKET):
    """``(a, b)`` between classes that may be similar; ``nodes(node, sketch, bands)``."""
    rows = nodes.select(
        F.explode("bands").alias("key"), "node",
        F.col("sketch")[0].alias("s"), F.col("sketch")[1].alias("t"),
    )
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub"))
    rows = rows.join(sizes.where("n > 1"), "key")
    small = rows.where(F.col("n") <= small_bucket).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("node", "s", "t"))).alias("of")
    )
    one = small.select(F.posexplode("of").alias("i", "x"), "of")
    other = F.filter(
        F.slice("of", F.col("i") + 2, small_bucket),
        lambda y: F.bit_count(y["s"].bitwiseXOR(F.col("x.s")))
        + F.bit_count(y["t"].bitwiseXOR(F.col("x.t"))) <= sketch_bits,
    )
    pairs = one.select(F.col("x.node").alias("a"), F.explode(other).alias("y")).select(
        "a", F.col("y.node").alias("b")
    )
    stars = rows.where((F.col("n") > small_bucket) & (F.col("node") != F.col("hub")))
    return pairs.unionByName(stars.select(F.col("hub").alias("a"), F.col("node").alias("b")))


class Forest:
    """Union-find over positions; remembers the links that joined two trees."""

    def __init__(self, n):
        self.up = np.arange(n)
        self.links = []

    def root(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i, j):
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def roots(self):
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def _common(one, values, first, which):
    """Sizes of the intersection of the set ``one`` with the sets ``which``."""
    lengths = first[which + 1] - first[which]
    edges = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(first[which] - edges[:-1], lengths) + np.arange(edges[-1])
    found = values[at]
    place = np.searchsorted(one, found)
    hit = one[np.minimum(place, len(one) - 1)] == found
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[edges[1:]] - total[edges[:-1]]


def exact_links(values, first, side, percent, table):
    """Spanning forest of the pairs with ``100 * common >= percent * union``.

    ``table`` has the signatures, ``side`` tells the block of each set. With two blocks only pairs across them are
    compared, as each block is compared within itself in a task of its own. A set is held
    against all sets that its signature estimate and size allow, the likeliest first;
    sets that are already connected need no count.
    """
    n = len(first) - 1
    margin = limits(percent, table.shape[1])[2]
    sizes = np.diff(first)
    forest = Forest(n)
    two = len(set(side.tolist())) > 1
    order = np.argsort(-sizes, kind="stable")
    for i in order:
        roots = forest.roots()
        may = roots != roots[i]
        may &= 100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])
        if two:
            may &= side != side[i]
        which = np.flatnonzero(may)
        if not len(which):
            continue
        guess = (table[which] == table[i]).mean(axis=1)
        near = guess >= percent / 100 - margin
        which, guess = which[near], guess[near]
        which = which[np.argsort(-guess, kind="stable")]
        one = values[first[i] : first[i + 1]]
        while len(which):
            now, which = which[:64], which[64:]
            common = _common(one, values, first, now)
            union = sizes[now] + sizes[i] - common
            for j in now[100 * common >= percent * union]:
                forest.join(int(i), int(j))
            roots = forest.roots()
            which = which[roots[which] != roots[i]]
    return forest.links


def _verify(percent, slots):
    def run(frame):
        import pandas as pd

        sets = [np.frombuffer(s, U64) for s in frame["set"]]
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        nodes = frame["node"].to_numpy()
        table = np.frombuffer(b"".join(frame["marks"]), np.uint16).reshape(-1, slots)
        links = exact_links(
            np.concatenate(sets), first, frame["side"].to_numpy(), percent, table
        )
        return pd.DataFrame(
            {"a": [nodes[i] for i, _ in links], "b": [nodes[j] for _, j in links]}
        ).astype("int64")

    return run


def links(docs, nodes, percent, width=WIDTH, slots=SLOTS, block=BLOCK, **bucket_options):
    """Links ``(a, b)`` between classes that connect exactly the similar ones."""
    sketch_bits = limits(percent, slots)[1]
    groups = connected_components(candidate_edges(nodes, sketch_bits, **bucket_options))
    members = groups.join(nodes.select("node", F.col("n_shingles").alias("n")), "node")
    members = staged(members, "candidates")
    texts = texts_of(docs).withColumnRenamed("doc_id", "node")
    wanted = texts.join(members.select("node"), "node", "left_semi")
    sets = staged(
        wanted.mapInArrow(_full_sets(width, slots), "node long, set binary, marks binary"), "sets"
    )
    return (
        block_pairs(members, percent, block).join(sets, "node")
        .groupBy(*TASK)
        .applyInPandas(_verify(percent, slots), "a long, b long")
    )


def same_id(found):
    """Links ``(a, b)`` between the classes of a doc_id that has several; ``found(doc_id, node)``."""
    ids = found.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last"))
    return found.join(ids.where("b < last"), "doc_id").where("node > b").select(
        F.col("node").alias("a"), "b"
    )


def near_duplicates(docs, percent=85, width=WIDTH, slots=SLOTS, **options):
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``."""
    rows = staged(features(docs, limits(percent, slots)[0], width, slots), "features")
    key = [F.col("print")[0].alias("p"), F.col("print")[1].alias("q"), "n_shingles"]
    real = rows.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy(*key).agg(F.min(F.struct("doc_id", "sketch", "bands")).alias("of"))
    classes = staged(
        classes.select("p", "q", "n_shingles", F.col("of.doc_id").alias("node"), "of.sketch", "of.bands"),
        "classes",
    )
    plain = rows.select("doc_id", *key)
    found = plain.where("n_shingles > 0 and doc_id is not null").join(
        classes.select("p", "q", "n_shingles", "node"), ["p", "q", "n_shingles"]
    )
    linked = links(docs, classes, percent, width, slots, **options)
    groups = connected_components(linked.unionByName(same_id(found)))
    named = classes.select("p", "q", "n_shingles", "node").join(groups, "node", "left").select(
        "p", "q", "n_shingles", F.coalesce("component", "node").alias("component_id")
    )
    alone = plain.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    found = (
        plain.where("n_shingles > 0 and doc_id is not null")
        .join(named, ["p", "q", "n_shingles"])
        .select("doc_id", "n_shingles", "component_id")
    )
    return found.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs, percent=80, **options):
    """``docs`` without the rows whose group has a smaller doc_id."""
    gone = near_duplicates(docs, percent, **options).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op1_near_dedup(spark, sf_dir):
    return near_duplicates(load(spark, sf_dir, "documents"), percent=85)


OP1_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {WIDTH - 1}], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_
    FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes s ON p.a = s.doc_id JOIN sizes t ON p.b = t.doc_id WHERE 100 * p.both_ >= 85 * (s.n + t.n - p.both_)
), reached AS (
  SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM docs d LEFT JOIN sizes s ON d.doc_id = s.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c ON d.doc_id = c.doc_id
"""
