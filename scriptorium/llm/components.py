"""Connected components of an edge table by alternating star contraction.

A large-star round points every larger neighbour of a node at the smallest node it knows,
a small-star round does so for the smaller ones. Both keep the components and end in stars
around the smallest id. Each step is a keyed minimum, combined before the exchange, and an
equi-join that the adaptive skew join may split, so a hub with very many edges is no single
task's work. No edge ever reaches the driver.
"""

from pyspark.sql import functions as F

from scriptorium.llm.tables import staged
from scriptorium.operators.skew import look_up


def _large_star(edges):
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = look_up(both.where("b > a"), least, ["a"], "b")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges):
    """``edges(a, b)`` with ``a > b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = look_up(edges, least, ["a"], "b").where("b > m").select(
        F.col("b").alias("a"), F.col("m").alias("b")
    )
    return least.select("a", F.col("m").alias("b")).unionByName(moved)


def _mark(edges):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges):
    """``(node, component)`` for all ends of ``edges(a, b)``; component is the smallest node."""
    edges = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = staged(edges.distinct(), "edges")
    mark = _mark(edges)
    while True:
        stars = _small_star(_large_star(edges).where("a > b").distinct())
        edges = staged(stars.where("a > b").distinct(), "edges")
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    leaves = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)
