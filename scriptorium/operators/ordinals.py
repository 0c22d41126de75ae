"""Exact ordinals over groups of any size.

``row_number() over (partition by key)`` sorts a whole group in one task. That is fine up
to ``HOT_ROWS`` rows. Keys with more are counted in blocks of ``2**BLOCK_BITS`` values of
the ordering integer; what stands before a block comes from counts per block. Where values
are unique within a key, that bounds every window by as many rows, however many a key has.

Both ways give the same numbers: nulls come first, equal values get consecutive ordinals,
and every row of a key, also of the null key, gets one of its own.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.operators.skew import HOT_ROWS, split_hot

BLOCK_BITS = 20
# 2**20 values per block, blocks and blocks of blocks: at most 2**24 rows are left on top
LEVELS = 2
# before any other value
NULLS_FIRST = -(1 << 63)


def _sum_before(df, keys, order, amount, out, levels):
    """Add ``out``: the sum of ``amount`` over rows of the same keys with smaller ``order``."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if levels == 0:
        window = before.partitionBy(*(keys or [F.lit(0)]))
        return df.withColumn(out, F.coalesce(F.sum(amount).over(window), F.lit(0)))
    block, base = f"_block{levels}", f"_base{levels}"
    cut = df.withColumn(block, F.shiftright(order, BLOCK_BITS))
    totals = cut.groupBy(*keys, block).agg(F.sum(amount).alias("_total"))
    bases = _sum_before(totals, keys, block, "_total", base, levels - 1).drop("_total")
    # same keys as the join below, which then needs no exchange of its own
    within = F.sum(amount).over(before.partitionBy(*keys, block))
    return (
        cut.withColumn(out, F.coalesce(within, F.lit(0)))
        .join(bases, [*keys, block])
        .select(*df.columns, (F.col(out) + F.col(base)).alias(out))
    )


def _in_blocks(df, keys, order, out):
    counted = df.withColumn("_one", F.lit(1).cast("long")).withColumn(
        "_order", F.coalesce(order, F.lit(NULLS_FIRST))
    )
    # a key that is null joins with nothing, so nulls stand behind a flag and a default
    safe = []
    for i, key in enumerate(keys):
        plain = F.coalesce(key, F.lit(0).cast(dict(df.dtypes)[key]))
        counted = counted.withColumn(f"_null{i}", F.col(key).isNull()).withColumn(f"_key{i}", plain)
        safe += [f"_null{i}", f"_key{i}"]
    numbered = _sum_before(counted, safe, "_order", "_one", out, LEVELS)
    return numbered.select(*df.columns, out)


def with_ordinal(df, keys, order, out, sized_by=None, hot_rows=HOT_ROWS):
    """Add ``out`` = 0-based position by the bigint ``order`` within ``keys``.

    ``sized_by`` and ``hot_rows`` are those of ``split_hot``.
    """
    if not keys:
        return _in_blocks(df, keys, order, out)
    _, plain, heavy = split_hot(df, keys, sized_by, hot_rows)
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    numbered = plain.withColumn(out, (position - 1).cast("long"))
    blocked = _in_blocks(heavy, keys, order, out)
    return numbered.select(*df.columns, out).unionByName(blocked)
