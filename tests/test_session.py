"""The shared folder and the spreading of small inputs."""

from types import SimpleNamespace

import pytest

from scriptorium import session
from scriptorium.plans.queries import QUERIES


def fake(master, folder=None):
    settings = {} if folder is None else {"spark.checkpoint.dir": folder}
    return SimpleNamespace(
        conf=SimpleNamespace(get=settings.get), sparkContext=SimpleNamespace(master=master)
    )


def test_configured_folder_is_used():
    first, second = (session.shared_folder(fake("yarn", "/shared"), "x") for _ in range(2))
    assert first.startswith("/shared/x-") and first != second


def test_only_a_local_session_may_do_without():
    assert session.shared_folder(fake("local[4]"), "x").startswith("/tmp/spark-")
    with pytest.raises(ValueError):
        session.shared_folder(fake("yarn"), "x")


def test_only_few_bytes_are_spread(spark, monkeypatch):
    few = spark.range(0, 1000, 1, 1)
    assert session.spread(few).rdd.getNumPartitions() == 4
    monkeypatch.setattr(session, "SPREAD_BYTES", 10)
    assert session.spread(few) is few


def test_settings_of_a_session_made_elsewhere(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "false")
    assert session.apply_settings(other) is other
    assert all(other.conf.get(k) == v for k, v in session.SETTINGS.items())


def test_parts_grow_with_the_table(spark, tmp_path):
    texts = spark.range(200_000, numPartitions=1).selectExpr("id AS doc_id", "sha2(CAST(id AS STRING), 256) AS text")
    texts.write.parquet(str(tmp_path / "texts"))
    docs = spark.read.parquet(str(tmp_path / "texts"))
    cores = spark.sparkContext.defaultParallelism
    assert session.parts_of(docs.limit(1)) == cores
    parts = session.parts_of(docs, 1 << 20)
    assert parts > cores and session.parts_of(docs.union(docs), 1 << 20) > 1.9 * parts


@pytest.mark.parametrize("name", ["keyword_topk", "key_phrases"])
def test_words_are_dealt_by_the_size_of_the_table(spark, sf_dir, monkeypatch, name):
    """Not by the session's number of shuffle partitions, which stays when a table grows."""
    monkeypatch.setattr(session, "planned_bytes", lambda df: 1 << 30)
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "REPARTITION_BY_NUM" in line and "hashpartitioning" in line]
    assert "SortMergeJoin" not in plan if name == "key_phrases" else plan.count("Join") == 1
    assert dealt and all("256" in line or "4096" in line for line in dealt), plan
