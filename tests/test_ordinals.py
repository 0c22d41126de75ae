"""Ordinals against a plain row number, on the way for hot keys too."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.operators import ordinals


@pytest.fixture
def numbered(table):
    rng = random.Random(7)
    sparse = rng.sample(range(-(1 << 50), 1 << 50), 300)
    dense = [(1 << 21) + n for n in range(300)]
    few = rng.sample(range(1000), 5)
    return table(
        "key long, pos long",
        *((1, p) for p in sparse), *((2, p) for p in dense), *((3, p) for p in few),
    )


@pytest.mark.parametrize("hot_rows", [0, 100, 10**6])
def test_ordinals_within_keys(numbered, hot_rows):
    found = ordinals.with_ordinal(numbered, ["key"], "pos", "n", hot_rows=hot_rows)
    expected = F.row_number().over(Window.partitionBy("key").orderBy("pos")) - 1
    assert found.count() == 605
    assert found.withColumn("expected", expected).where("n <> expected").count() == 0


@pytest.mark.parametrize("hot_rows", [0, 10**6])
def test_nulls_and_repeated_values(table, hot_rows):
    schema = "key long, pos long"
    odd = table(schema, (1, None), (1, None), (1, 5), (1, 5), (1, 7), (None, 3), (None, None), (2, None))
    found = ordinals.with_ordinal(odd, ["key"], "pos", "n", hot_rows=hot_rows).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(
        [(1, None, 0), (1, None, 1), (1, 5, 2), (1, 5, 3), (1, 7, 4), (None, None, 0), (None, 3, 1), (2, None, 0)],
        key=repr,
    )
    whole = ordinals.with_ordinal(odd.where("key = 1"), [], "pos", "n").collect()
    assert sorted((r.n, r.pos) for r in whole) == [(0, None), (1, None), (2, 5), (3, 5), (4, 7)]


@pytest.mark.parametrize("bits", [4, 20])
def test_ordinals_over_everything(numbered, bits, monkeypatch):
    monkeypatch.setattr(ordinals, "BLOCK_BITS", bits)
    distinct = numbered.select(F.col("pos") * 4 + F.col("key")).toDF("pos")
    found = ordinals.with_ordinal(distinct, [], "pos", "n").collect()
    assert [r.n for r in sorted(found)] == list(range(605))
