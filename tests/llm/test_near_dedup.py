import random

import corpus_pipeline
from reference import near_groups

from scriptorium.llm.components import connected_components
from scriptorium.llm.near_dedup import (
    drop_near_duplicates, limits, near_duplicates, op1_near_dedup,
)

COLUMNS = ("doc_id", "n_shingles", "component_id")


def variants(count, seed, words=60, edits=6):
    """Texts around one base, some similar enough and some not."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(9999)}" for _ in range(words)]
    out = []
    for _ in range(count):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"x{rng.randrange(9999)}"
        out.append(" ".join(own))
    return out


def expected(texts):
    return sorted((i, n, c) for i, (n, c) in near_groups(dict(enumerate(texts))).items())


def test_groups_equal_all_pairs(documents, rows):
    texts = variants(60, 1) + variants(40, 2, words=12, edits=3) + ["a b", "A  B", "b a", "c"]
    assert rows(near_duplicates(documents(*texts)), *COLUMNS) == sorted(expected(texts), key=repr)


def test_large_buckets_and_many_blocks_change_nothing(documents, rows):
    texts = variants(90, 3)
    found = near_duplicates(documents(*texts), small_bucket=4, block=8)
    assert rows(found, *COLUMNS) == sorted(expected(texts), key=repr)


def test_threshold_is_inclusive(documents, rows):
    # 17 shared shingles of 20: exactly 85 of 100
    a = " ".join(f"w{i}" for i in range(24))
    b = " ".join([*(f"w{i}" for i in range(21))])
    found = {r[0]: r[2] for r in rows(near_duplicates(documents(a, b)), *COLUMNS)}
    assert found == {0: 0, 1: 0}


def test_awkward_rows(clashing):
    found = near_duplicates(clashing).collect()
    assert len(found) == clashing.count()
    of = {}
    for row in found:
        of.setdefault(row["doc_id"], []).append((row["n_shingles"], row["component_id"], row["kept"]))
    assert of[0] == of[1][:1] == [(0, 0, True)] or of[0] == [(0, 0, True)]
    assert of[1] == [(0, 1, True)] and of[2] == [(0, 2, True)]
    assert of[3] == [(1, 3, True)] * 2 and of[4] == [(1, 3, False)]
    assert of[5][0][1:] == (5, True) and of[6][0][1:] == (5, False)
    assert of[None] == [(1, None, True)]


def test_empty_table(documents):
    assert near_duplicates(documents()).count() == 0


def test_one_of_each_group_stays(documents, rows):
    docs = documents("a b c d e f g h", "a b c d e f g h", "z", None, None)
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert [r[0] for r in rows(left, "doc_id")] == [0, 2, 3, 4]


def test_components_of_long_chains(table, rows):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    found = dict(rows(connected_components(table("a long, b long", *chain))))
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_query(spark, sf_dir, rows):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = near_groups(texts)
    found = rows(op1_near_dedup(spark, sf_dir), *COLUMNS, "kept")
    assert found == sorted(((i, n, c, i == c) for i, (n, c) in want.items()), key=repr)


def test_groups_at_80_equal_all_pairs(documents, rows):
    texts = variants(60, 1) + variants(40, 2, words=12, edits=3) + variants(40, 4, edits=9)
    want = near_groups(dict(enumerate(texts)), percent=80)
    assert want != near_groups(dict(enumerate(texts)))
    found = rows(near_duplicates(documents(*texts), percent=80), *COLUMNS)
    assert found == sorted(((i, n, c) for i, (n, c) in want.items()), key=repr)


def test_stage_of_the_pipeline_takes_80(spark, documents, rows):
    # 16 shared shingles of 20, then 15
    long = [f"w{i}" for i in range(24)]
    other = [f"v{i}" for i in range(24)]
    docs = documents(*(" ".join(x) for x in (long, long[:20], other, other[:19])))
    left = corpus_pipeline.near_dedup(spark, docs, None)
    assert rows(left, "doc_id") == [(0,), (2,), (3,)]
    assert len(rows(near_duplicates(docs, percent=85).where("kept"))) == 4


def test_limits_follow_the_threshold():
    assert limits(85)[:2] == (25, 30) and limits(80)[:2] == (31, 36)
    assert 0.159 < limits(85)[2] < 0.16 and 0.178 < limits(80)[2] < 0.179
