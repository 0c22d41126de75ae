"""Nearest neighbours by cosine with multiprobe p-stable hashing.

Unit vectors are hashed by ``floor((a . x + b) / width)`` with k Gaussian directions a, in
``TABLES`` tables; k grows with the logarithm of the rows, so that a bucket keeps about
``BUCKET_ROWS`` of them. A query visits, in each table, its own bucket and those around it in
the order of the probability that a vector at distance r lies there, until that adds up to
``TARGET`` over all tables. r is the distance of the wanted neighbours within a sample of
at most ``SAMPLE`` vectors, where neighbours are not nearer than among all. All rows of the visited
buckets are ranked by the exact cosine in double precision.

Equal vectors are one entry with its smallest ids, as many as an answer can need; equal query
vectors are searched once. Buckets are dealt to tasks of bounded size, larger buckets in several
splits that the query visits all; a task returns only the best of its share per query. A
query that finds too few rows is held against all rows, in the same blocks.

Edge cases: a vector that is null, empty, zero, or holds nulls or non-finite numbers takes no part,
nor does one whose length is not the commonest; rows without id take no part; the query's
own id is no candidate; equal scores stand in order of id; an empty table gives an empty one.
"""

import heapq
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.llm.tables import load, staged
from scriptorium.llm.words import mix
from scriptorium.operators.skew import look_up

TABLES = 2
WIDTH = 1.5
BUCKET_ROWS = 256
# how many buckets a direction of this width makes of unit vectors, in effect
BRANCHES = 3.3
TARGET = 0.985
SAMPLE = 20_000
SAMPLE_QUERIES = 200
SHARD_ROWS = 8192
SEED = 11


@dataclass
class Index:
    directions: np.ndarray  # tables x dimensions x k
    shifts: np.ndarray  # tables x k
    reach: float
    shards: int

    def places(self, vectors):
        """Bucket coordinates and places in them per table: ``(tables, rows, k)`` each."""
        units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        spots = np.einsum("rd,tdk->trk", units, self.directions) / WIDTH + self.shifts[:, None, :]
        cells = np.floor(spots).astype(np.int64)
        return cells, spots - cells


def bucket_keys(table, cells):
    """One 64-bit number per row of bucket coordinates."""
    keys = np.full(len(cells), table + 1, np.uint64)
    with np.errstate(over="ignore"):
        for column in cells.T:
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return keys.view(np.int64)


def _normal(x):
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def probes(fractions, reach, enough):
    """Offsets of buckets in falling order of success, until their sum is ``enough``.

    ``fractions`` tell where in its bucket the query lies; a neighbour lies a normal step of
    deviation ``reach`` away in each direction.
    """
    k = len(fractions)
    steps = range(-6, 7)
    options = []
    for f in fractions:
        chance = [
            _normal((d + 1 - f) * WIDTH / reach) - _normal((d - f) * WIDTH / reach) for d in steps
        ]
        options.append(sorted(((p, d) for p, d in zip(chance, steps) if p > 1e-9), reverse=True))
    own = tuple([0] * k)
    out, total = [own], 0.0
    first = math.prod(o[0][0] for o in options)
    heap, seen = [(-first, own)], {own}
    while heap and total < enough:
        chance, at = heapq.heappop(heap)
        total -= chance
        offset = tuple(options[i][j][1] for i, j in enumerate(at))
        if any(offset):
            out.append(offset)
        for i in range(k):
            j = at[i] + 1
            following = at[:i] + (j,) + at[i + 1 :]
            if j < len(options[i]) and following not in seen:
                seen.add(following)
                heapq.heappush(heap, (chance * options[i][j][0] / options[i][j - 1][0], following))
    return out


def valid_vectors(rows):
    """``(vec_id, vector)`` of the rows that take part."""
    rows = rows.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")
    ).where("vec_id is not null and size(vector) > 0")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~odd & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n")
    common = lengths.first()
    return rows.where(F.size("vector") == (common["n"] if common else 0)), common


def fit(entries, size, rows, wanted, tables=TABLES, sample=SAMPLE):
    """Directions, and the reach of the wanted neighbours within a bounded sample."""
    taken = entries.orderBy(F.xxhash64("entry"), "entry").limit(sample).select("vector").toPandas()
    vectors = np.array(taken["vector"].tolist(), float).reshape(-1, size)
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    reach = 1.0
    if len(units) > wanted:
        some = units[:SAMPLE_QUERIES] @ units.T
        nearest = np.sort(some, axis=1)[:, -wanted - 1]
        reach = max(float(np.sqrt(np.maximum(2 - 2 * nearest, 0)).mean()), 0.05)
    k = max(0, int(math.log(max(rows, 1) / BUCKET_ROWS) / math.log(BRANCHES)))
    random = np.random.default_rng(SEED)
    return Index(
        random.normal(size=(tables, size, k)), random.uniform(0, 1, (tables, k)), reach,
        max(1, math.ceil(rows * tables / SHARD_ROWS)),
    )


def _vectors(column, size):
    return np.array(column.tolist(), float).reshape(-1, size)


def _place(index, size):
    def run(frames):
        import pandas as pd

        for frame in frames:
            cells, _ = index.places(_vectors(frame["vector"], size))
            yield pd.concat(
                pd.DataFrame({
                    "table": t, "bucket": bucket_keys(t, own), "entry": frame["entry"],
                    "ids": frame["ids"], "vector": frame["vector"],
                }) for t, own in enumerate(cells)
            )

    return run


def _visit(index, size, target):
    enough = 1 - (1 - target) ** (1 / len(index.shifts))

    def run(frames):
        import pandas as pd

        for frame in frames:
            cells, fractions = index.places(_vectors(frame["vector"], size))
            for t in range(len(cells)):
                for i, (entry, vector) in enumerate(zip(frame["entry"], frame["vector"])):
                    offsets = np.array(probes(fractions[t, i], index.reach, enough), np.int64)
                    yield pd.DataFrame({
                        "table": t, "bucket": bucket_keys(t, cells[t, i] + offsets.reshape(len(offsets), -1)),
                        "query": entry,
                    })

    return run


def _best(size, wanted):
    """Best rows of one task's share for each of its queries."""
    def run(key, stored, asked):
        import pandas as pd

        kinds = {"query": "int64", "entry": "int64", "score": "float64", "ids": "object"}
        empty = pd.DataFrame({name: pd.Series([], dtype=kind) for name, kind in kinds.items()})
        if not len(stored) or not len(asked):
            return empty
        stored = stored.sort_values("bucket", kind="stable").reset_index(drop=True)
        rows, buckets = _vectors(stored["vector"], size), stored["bucket"].to_numpy()
        rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        entries = stored["entry"].to_numpy()
        out = []
        for query, buckets_asked, vector in zip(asked["query"], asked["buckets"], asked["vector"]):
            vector = np.asarray(vector, float)
            if buckets_asked is None:
                at = np.arange(len(rows))
            else:
                wish = np.unique(np.asarray(buckets_asked, np.int64))
                low, high = np.searchsorted(buckets, wish), np.searchsorted(buckets, wish, "right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(low, high)])
            at = at[np.unique(entries[at], return_index=True)[1]]  # found in several tables
            if not len(at):
                continue
            scores = rows[at] @ (vector / np.linalg.norm(vector))
            if len(at) > 4 * wanted:
                least = np.partition(scores, -wanted)[-wanted]
                near = scores >= least
                at, scores = at[near], scores[near]
            order = np.lexsort((entries[at], -scores))[:wanted]
            out += [(query, entries[i], s, stored["ids"][i]) for i, s in zip(at[order], scores[order])]
        return pd.DataFrame(out, columns=list(kinds)) if out else empty

    return run


FOUND = "query long, entry long, score double, ids array<long>"


def nearest(rows, queries, wanted=5, target=TARGET, tables=TABLES, sample=SAMPLE):
    """``(query_id, rank, vec_id, score)``: the nearest of ``rows`` for the ids in ``queries``.

    ``queries`` is a condition on ``vec_id``.
    """
    rows, common = valid_vectors(rows)
    size = common["n"] if common else 1
    order = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= wanted + 1)
    entries = staged(
        few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .select(F.get("ids", F.lit(0)).alias("entry"), "ids", "vector"),
        "entries",
    )
    index = fit(entries, size, entries.count(), wanted, tables, sample)
    asking = rows.where(queries).select("vec_id", "vector").distinct()
    asked = staged(
        asking.join(entries.select("vector", "entry"), "vector").select(
            F.col("vec_id").alias("query_id"), F.col("entry").alias("query")
        ), "asked",
    )
    vectors = entries.select(F.col("entry").alias("query"), "vector").join(
        asked.select("query"), "query", "left_semi"
    )
    stored = entries.mapInPandas(
        _place(index, size), "table int, bucket long, entry long, ids array<long>, vector array<double>"
    )
    large = stored.groupBy("table", "bucket").agg(
        F.ceil(F.count("*") / SHARD_ROWS).alias("splits")
    ).where("splits > 1")
    shard = F.pmod(F.xxhash64("table", "bucket", "split"), F.lit(index.shards)).alias("shard")
    splits = F.coalesce("splits", F.lit(1))
    stored = look_up(stored, large, ["table", "bucket"], "entry", "left").withColumn(
        "split", F.pmod(F.xxhash64("entry"), splits)
    ).select(shard, "bucket", "entry", "ids", "vector", "table")
    visits = vectors.withColumnRenamed("query", "entry").mapInPandas(
        _visit(index, size, target), "table int, bucket long, query long"
    ).join(large, ["table", "bucket"], "left").withColumn(
        "split", F.explode(F.sequence(F.lit(0).cast("long"), splits - 1))
    ).select("query", "bucket", shard).groupBy("query", "shard").agg(
        F.collect_list("bucket").alias("buckets")
    ).join(vectors, "query")
    found = staged(_search(stored, visits, size, wanted), "found")
    enough = found.groupBy("query").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") > wanted)
    short = vectors.join(enough, "query", "left_anti")
    if not short.isEmpty():
        everywhere = short.select(
            "query", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(index.shards - 1).cast("long"))).alias("shard"),
            F.lit(None).cast("array<long>").alias("buckets"), "vector",
        )
        found = found.unionByName(_search(stored.where("table = 0"), everywhere, size, wanted))
    best = found.groupBy("query", "entry").agg(F.max(F.struct("score", "ids")).alias("of")).select(
        "query", "entry", "of.score", "of.ids"
    )
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))
    best = best.withColumn("at", rank).where(F.col("at") <= wanted + 1).select("query", "score", "ids")
    pairs = asked.join(best, "query").select(
        "query_id", F.explode("ids").alias("vec_id"), "score"
    ).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= wanted).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def _search(stored, visits, size, wanted):
    asked = visits.select("shard", "query", "buckets", "vector").groupBy("shard")
    return stored.select("shard", "bucket", "entry", "ids", "vector").groupBy("shard").cogroup(
        asked
    ).applyInPandas(_best(size, wanted + 1), FOUND)


def op7_neighbours(spark, sf_dir):
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
