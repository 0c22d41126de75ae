"""Members of candidate groups dealt to tasks that each compare two bounded blocks.

Sets whose similarity reaches the threshold have sizes in that ratio. Sizes are put into classes as
wide as the ratio, so only blocks of one class or of two neighbouring ones are ever paired. A block
has about ``block`` members and ``weight`` elements, however large the group; a group
that fits into one block is one.
"""

import math

from pyspark.sql import functions as F

from scriptorium.operators.skew import look_up

BLOCK = 256
WEIGHT = 1 << 18


def block_pairs(members, percent, block=BLOCK, weight=WEIGHT):
    """``(node, component, side, c1, b1, c2, b2)``: the tasks that each member goes to.

    ``members(node, component, n)``: ``n`` is the size of the member's set. A task is a component
    and two (class, block); ``side`` tells in which of them the member is. Every pair whose
    sizes allow the similarity meets in exactly one task.
    """
    def enough(count, total):
        return F.ceil(F.greatest(count / F.lit(block), total / F.lit(weight))).cast("int")

    totals = members.groupBy("component").agg(
        enough(F.count("*"), F.sum("n")).alias("parts")
    )
    # a little wider than the ratio, so that rounding never parts sizes that just reach it
    width = math.log(100 / percent) + 1e-6 if percent < 100 else 1e-6
    size_class = F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(width)).cast("int")
    classed = look_up(members, totals, ["component"], "node").select(
        "node", "component", "n",
        F.when(F.col("parts") <= 1, F.lit(0)).otherwise(size_class).alias("c"),
    )
    counts = classed.groupBy("component", "c").agg(
        enough(F.count("*"), F.sum("n")).alias("blocks")
    )
    around = (
        counts.select("component", F.explode(F.array("c", F.col("c") + 1, F.col("c") - 1)).alias("at"),
                      F.col("c").alias("from"), "blocks")
        .groupBy("component", F.col("at").alias("c"))
        .agg(*(
            F.coalesce(F.max(F.when(F.col("from") == F.col("at") + step, F.col("blocks"))), F.lit(0)).alias(name)
            for name, step in (("blocks", 0), ("above", 1), ("below", -1))
        ))
        .where("blocks > 0")
    )
    placed = look_up(classed, around, ["component", "c"], "node").withColumn(
        "b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )

    def tasks(count, make):
        numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, make)

    def task(c1, b1, c2, b2, side):
        return F.struct(
            c1.alias("c1"), b1.alias("b1"), c2.alias("c2"), b2.alias("b2"), side.cast("int").alias("side")
        )

    c, b = F.col("c"), F.col("b")
    own = tasks(F.col("blocks"), lambda j: task(c, F.least(b, j), c, F.greatest(b, j), b > j))
    above = tasks(F.col("above"), lambda j: task(c, b, c + 1, j, F.lit(0)))
    below = tasks(F.col("below"), lambda j: task(c - 1, j, c, b, F.lit(1)))
    return placed.select("node", "component", F.inline(F.concat(own, above, below)))


TASK = ("component", "c1", "b1", "c2", "b2")
