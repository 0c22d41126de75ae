"""Streams over several micro-batches and over restarts."""

import datetime

from scriptorium.operators import edits as ed
from scriptorium.plans import fixtures as fx
from scriptorium.schemas import UPLOADS
from scriptorium.streaming import edits as stream_edits
from scriptorium.streaming import uploads as stream_up


def arriving(spark, schema, folder):
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    )


def test_streamed_edits_equal_batch(spark, sf_dir, tmp_path):
    edits = fx.edits(spark, sf_dir)
    expected = ed.latest_edits(edits, ed.BLOCK)
    # the newest edits arrive first
    halves = [edits.where("seq >= 500"), edits.where("seq < 500")]
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for half in halves:
        half.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream_edits.stream_latest_edits(
            arriving(spark, edits.schema, tmp_path / "in"), ed.BLOCK, out, progress
        )
    assert len(list((tmp_path / "out").glob("batch=*"))) == 6
    found = stream_edits.read_latest_edits(spark, ed.BLOCK, out)
    assert found.count() == expected.count()
    assert found.exceptAll(expected).isEmpty()


def test_compaction_between_batches(spark, sf_dir, tmp_path):
    edits = fx.edits(spark, sf_dir)
    progress = str(tmp_path / "progress")
    out, compact = str(tmp_path / "out"), str(tmp_path / "compact")
    for half, target in ((edits.where("seq >= 500"), out), (edits.where("seq < 500"), compact)):
        half.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = arriving(spark, edits.schema, tmp_path / "in")
        stream_edits.stream_latest_edits(stream, ed.PARAGRAPH, target, progress)
        if target == out:
            stream_edits.compact_latest_edits(spark, ed.PARAGRAPH, out, compact)
    found = stream_edits.read_latest_edits(spark, ed.PARAGRAPH, compact)
    assert sorted(found.collect()) == sorted(ed.latest_edits(edits, ed.PARAGRAPH).collect())


def test_uploads_enter_the_catalog_once(spark, table, tmp_path):
    day = datetime.date(2024, 1, 1)

    def send(*uploads):
        rows = [(doc_id, seq, name, 1, "me", day) for doc_id, seq, name in uploads]
        table(UPLOADS, *rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream_up.stream_uploads(
            arriving(spark, UPLOADS, tmp_path / "in"),
            str(tmp_path / "catalog"), str(tmp_path / "progress"),
        )
        catalog = stream_up.read_uploads(spark, str(tmp_path / "catalog"))
        return sorted((r.doc_id, r.name) for r in catalog.collect())

    assert send((1, 2, "again.pdf"), (1, 1, "a.pdf"), (2, 3, "b.txt")) == [(1, "a.pdf")]
    assert send((1, 4, "late.pdf"), (2, 5, "b.docx")) == [(1, "a.pdf"), (2, "b.docx")]


def test_a_batch_run_twice_changes_nothing(spark, table, tmp_path):
    """After a failure a batch runs again; without its progress all of them do."""
    day = datetime.date(2024, 1, 1)
    table(UPLOADS, (1, 1, "a.pdf", 1, "me", day)).write.parquet(str(tmp_path / "in"))
    for attempt in range(2):
        stream_up.stream_uploads(
            arriving(spark, UPLOADS, tmp_path / "in"),
            str(tmp_path / "catalog"), str(tmp_path / f"progress{attempt}"),
        )
    assert stream_up.read_uploads(spark, str(tmp_path / "catalog")).count() == 1


def test_compacted_uploads_are_the_same_catalog(spark, table, tmp_path):
    day = datetime.date(2024, 1, 1)
    path, progress = str(tmp_path / "catalog"), str(tmp_path / "progress")
    for part in ([(1, 1), (2, 2)], [(2, 3), (3, 4)]):
        rows = [(doc_id, seq, f"{doc_id}.pdf", 1, "me", day) for doc_id, seq in part]
        table(UPLOADS, *rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream_up.stream_uploads(arriving(spark, UPLOADS, tmp_path / "in"), path, progress)
    stream_up.compact_uploads(spark, path, str(tmp_path / "compact"))
    found = [stream_up.read_uploads(spark, p) for p in (path, str(tmp_path / "compact"))]
    assert sorted(found[0].collect()) == sorted(found[1].collect())
    assert sorted((r.doc_id, r.seq) for r in found[1].collect()) == [(1, 1), (2, 2), (3, 4)]


def test_state_equals_batch_after_each_batch(spark, sf_dir, tmp_path):
    edits = fx.edits(spark, sf_dir).cache()
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    come = edits.limit(0)
    for lot in (4, 2, 0, 3, 1):  # out of order in seq
        part = edits.where(f"seq % 5 = {lot}")
        come = come.unionByName(part)
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(edits.schema).parquet(str(tmp_path / "in"))
        stream_edits.stream_latest_edits(stream, ed.PARAGRAPH, out, progress)  # a restart each
        want = sorted(ed.latest_edits(come, ed.PARAGRAPH).collect())
        state = stream_edits.edits_in_state(spark, ed.PARAGRAPH, progress)
        assert sorted(state.collect()) == want  # one row of state per address
        assert sorted(stream_edits.read_latest_edits(spark, ed.PARAGRAPH, out).collect()) == want
    edits.unpersist()


def test_uploads_read_no_more_as_the_catalog_grows(spark, table, tmp_path):
    day = datetime.date(2024, 1, 1)
    read = []
    for batch in range(5):
        new = [(batch * 100 + i, batch * 1000 + i, "a.pdf", 1, "me", day) for i in range(100)]
        old = [(i, -1, "again.pdf", 1, "me", day) for i in range(batch * 100)][-20:]
        table(UPLOADS, *new, *old).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream_up.stream_uploads(
            spark.readStream.schema(UPLOADS).parquet(str(tmp_path / "in")),
            str(tmp_path / "catalog"), str(tmp_path / "progress"),
        )
        done = [p for p in query.recentProgress if p["numInputRows"]]
        assert [p["stateOperators"][0]["numRowsTotal"] for p in done] == [(batch + 1) * 100]
        read.append(sum(p["numInputRows"] for p in done))
    assert read == [100, 120, 120, 120, 120]  # the new files' rows, never the catalog's
    found = stream_up.read_uploads(spark, str(tmp_path / "catalog")).collect()
    assert sorted(r.doc_id for r in found) == list(range(500))
    assert {r.name for r in found} == {"a.pdf"}
