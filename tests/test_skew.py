"""Hot keys give the same rows as others, and joins on them can be cut."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators.skew import look_up, split_hot


@pytest.fixture
def skewed(spark):
    # key 0 holds more than half of the rows, key 7 and null are in no small row
    return spark.range(200).select(
        F.when(F.col("id") < 120, 0).when(F.col("id") != 150, F.col("id") % 8).alias("key"), "id"
    )


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("splits", [1, 2, 5])
def test_look_up_is_a_join(spark, rows, skewed, how, splits):
    small = spark.range(7).select(F.col("id").alias("key"), (F.col("id") * 10).alias("value"))
    found = look_up(skewed, small, ["key"], "id", how, splits)
    assert rows(found, "key", "id", "value") == rows(skewed.join(small, "key", how), "key", "id", "value")


def test_look_up_below_an_aggregate_has_exchanges_of_its_own(spark, skewed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = skewed.groupBy("key").agg(F.min("id").alias("first"))
        plan = look_up(skewed, first, ["key"], "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(key") == 3


@pytest.mark.parametrize("hot_rows", [0, 50, 10**6])
def test_hot_keys_are_separated(rows, skewed, hot_rows):
    hot, plain, heavy = split_hot(skewed, ["key"], hot_rows=hot_rows)
    assert rows(plain.unionByName(heavy)) == rows(skewed)
    assert hot.count() == {0: 9, 50: 1, 10**6: 0}[hot_rows]
