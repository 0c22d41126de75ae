"""Jaccard join of documents on their n-grams as a blocked sparse matrix product.

Rows of the matrix are the distinct n-gram sets (documents with equal sets are one row), columns are
n-grams; the product of the matrix with its transpose holds the size of every intersection.

1. Blocks. Rows are grouped so that rows of different groups have no product entry that counts
   (MinHash bands, as many as hide a pair at the threshold with probability 1e-6 at most), and the
   groups are cut by set size: of ``a >= b`` elements at most b are common, so rows whose sizes are
   further apart than the threshold never meet. A task gets two blocks of about 256 rows, or 2^18
   elements, whatever the size of a group.
2. Product. In a task, columns of one row are left out; the others are multiplied in slabs of
   ``SLAB`` columns, the two dense slabs of zeros and ones adding up the overlap counts.
3. Bounds. A pair needs ``percent * (a + b) / (100 + percent)`` common elements. After each slab
   a pair is discarded once its count and the elements that either row has left cannot reach that; a
   row without pairs leaves the product, and the product ends when no pair is left.
4. What reaches its bound is a link. A task returns a spanning forest of its links, whose
   connected components over all tasks are those of all links.

Edge cases: null or blank text has the empty set, ``n_shingles`` 0, and links with nothing; a
text of fewer words than ``width`` is one n-gram of all its words. Rows of one doc_id are one
document: their sets share a component, each row has its own ``n_shingles``. A row without doc_id
links with nothing and has no ``component_id``. An empty table gives an empty one.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from scriptorium.llm.blocks import BLOCK, TASK, block_pairs
from scriptorium.llm.components import connected_components
from scriptorium.llm.near_dedup import candidate_edges, features, limits, same_id
from scriptorium.llm.tables import load, staged, texts_of
from scriptorium.llm.words import (
    U64, distinct, lowered, pieces, shingle_hashes, text_bytes, word_hashes,
)

WIDTH = 5
PERCENT = 80
SLAB = 4096


def _incidence(width):
    """Column hashes of every row, 8 bytes each and rising."""
    def run(batches):
        for batch in pieces(batches):
            data, offsets = text_bytes(batch["text"])
            words, first, _, _ = word_hashes(lowered(data), offsets)
            values, first = distinct(*shingle_hashes(words, first, width))
            packed = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch["node"], pa.array(packed, pa.binary())], ["node", "columns"]
            )

    return run


def _shared_columns(rows):
    """``(row, column)`` of all entries in columns of two rows or more, columns from 0 on."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    _, column, times = np.unique(
        np.concatenate([np.zeros(0, U64), *rows]), return_inverse=True, return_counts=True
    )
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    return row[order], column[order]


def product_links(rows, side, percent, slab=SLAB):
    """Position pairs whose overlap reaches the threshold, from sets as arrays of hashes.

    Rows of side 0 are multiplied with those of side 1, or all with each other if there is but
    one side.
    """
    sizes = np.array([len(r) for r in rows])
    sides = [np.flatnonzero(side == s) for s in (0, 1)]
    one, other = sides if all(map(len, sides)) else (np.arange(len(rows)),) * 2
    row, column = _shared_columns(rows)
    left = np.bincount(row, minlength=len(rows))
    need = -(-percent * (sizes[one][:, None] + sizes[other][None, :]) // (100 + percent))
    counts = np.zeros(need.shape, np.float32)
    live = (need > 0) & (np.minimum(left[one][:, None], left[other][None, :]) >= need)
    if one is other:
        live &= np.tri(len(rows), k=-1, dtype=bool)
    edges = np.searchsorted(column, np.arange(0, len(column) + slab + 1, slab))
    for start, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        up, down = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
        if a == b or not len(up):
            break
        dense = np.zeros((len(rows), slab), np.float32)
        dense[row[a:b], column[a:b] - start * slab] = 1
        counts[np.ix_(up, down)] += dense[one[up]] @ dense[other[down]].T
        left = left - np.bincount(row[a:b], minlength=len(rows))
        live &= counts + np.minimum(left[one][:, None], left[other][None, :]) >= need
    at, to = np.nonzero(live & (counts >= need))
    return one[at], other[to]


def spanning(n, a, b):
    """Those of the links that join two trees, so that n nodes stay connected as by all."""
    up = np.arange(n)
    kept = []

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        x, y = root(i), root(j)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((i, j))
    return kept


def _multiply(percent, slab):
    def run(frame):
        rows = [np.frombuffer(c, U64) for c in frame["columns"]]
        found = product_links(rows, frame["side"].to_numpy(), percent, slab)
        nodes = frame["node"].to_numpy()
        links = [(nodes[i], nodes[j]) for i, j in spanning(len(rows), *found)]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def jaccard_links(docs, classes, percent=PERCENT, width=WIDTH, block=BLOCK, slab=SLAB, **buckets):
    """Links ``(a, b)`` that connect ``classes(node, n_shingles, sketch, bands)`` like all links."""
    groups = connected_components(candidate_edges(classes, limits(percent)[1], **buckets))
    sizes = classes.select("node", F.col("n_shingles").alias("n"))
    members = staged(groups.join(sizes, "node"), "members")
    texts = texts_of(docs).withColumnRenamed("doc_id", "node")
    matrix = staged(
        texts.join(members.select("node"), "node", "left_semi").mapInArrow(
            _incidence(width), "node long, columns binary"
        ), "incidence",
    )
    return (
        block_pairs(members, percent, block).join(matrix, "node")
        .groupBy(*TASK).applyInPandas(_multiply(percent, slab), "a long, b long")
    )


def ngram_join(docs, percent=PERCENT, width=WIDTH, **options):
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``."""
    rows = staged(features(docs, limits(percent)[0], width), "sets")
    key = ["p", "q", "n_shingles"]
    prints = [F.col("print")[0].alias("p"), F.col("print")[1].alias("q")]
    plain = rows.select("doc_id", *prints, "n_shingles")
    real = "n_shingles > 0 and doc_id is not null"
    classes = staged(
        rows.where(real).groupBy(*prints, "n_shingles")
        .agg(F.min(F.struct("doc_id", "sketch", "bands")).alias("of"))
        .select(*key, F.col("of.doc_id").alias("node"), "of.sketch", "of.bands"), "rows",
    )
    held = staged(plain.where(real).join(classes.select(*key, "node"), key), "held")
    links = jaccard_links(docs, classes, percent, width, **options)
    groups = connected_components(links.unionByName(same_id(held)))
    found = held.join(groups, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id")
    )
    alone = plain.where(f"not ({real})").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return found.unionByName(alone)


def op13_ngram_join(spark, sf_dir):
    return ngram_join(load(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {WIDTH - 1}], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), product AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS overlap
  FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM product JOIN sizes s ON a = s.doc_id JOIN sizes t ON b = t.doc_id
  WHERE 100 * overlap >= {PERCENT} * (s.n + t.n - overlap)
), reached AS (
  SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM docs d LEFT JOIN sizes s ON d.doc_id = s.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c ON d.doc_id = c.doc_id
"""
