"""Keys that hold very many rows, separated before anything is shuffled by key."""

from pyspark.sql import functions as F

HOT_ROWS = 1 << 20


def split_hot(df, keys, sized_by=None, hot_rows=HOT_ROWS):
    """``(hot keys, rows of other keys, rows of hot keys)``.

    There can be no more than rows / ``hot_rows`` hot keys, which bounds what is
    broadcast. Mostly there are none, and what follows on the hot rows falls away at run
    time. Where ``df`` is costly, ``sized_by`` can be a cheaper table with at least its
    rows per key.
    """
    sizes = (df if sized_by is None else sized_by).groupBy(*keys).agg(F.count("*").alias("_rows"))
    hot = F.broadcast(sizes.where(F.col("_rows") > hot_rows).select(*keys))
    return hot, df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")


def look_up(rows, small, keys, spread_by, how="inner", splits=2):
    """Join ``rows`` with ``small``, which was aggregated by the same ``keys``.

    A join right on top of that aggregate would share its exchange, and then a hot key is one
    task's work. A split number in the key gives both sides an exchange of their own, which
    the adaptive skew join cuts further wherever a key is hot.
    """
    number = F.pmod(F.xxhash64(spread_by), F.lit(splits)).cast("int")
    copies = small.withColumn("_split", F.explode(F.array(*(F.lit(i) for i in range(splits)))))
    return rows.withColumn("_split", number).join(copies, [*keys, "_split"], how).drop("_split")
