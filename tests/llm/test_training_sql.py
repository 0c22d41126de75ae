import pytest
from compare import compare, connect

from scriptorium.llm.queries import ORACLES, QUERIES

FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


@pytest.mark.parametrize("folder", FOLDERS)
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name, folder):
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) > 20


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
