"""Every registered query equals its SQL, row for row."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry
from scriptorium.plans.oracles import ORACLES
from scriptorium.plans.queries import QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, connection):
    assert compare(QUERIES[name](spark, sf_dir), connection, ORACLES[name]) > 0


# phrases are chosen one after the other by edit distance: compared with plain Python instead
WITHOUT_SQL = {"key_phrases"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) | WITHOUT_SQL


def test_entry(spark):
    flagship = entry(spark)
    assert flagship.columns == ["doc_id", "matches"]
    assert flagship.count() > 0
