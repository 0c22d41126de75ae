import random

import reference
from hypothesis import given, settings
from hypothesis import strategies as st
from reference import blank_words, seen_lines

from scriptorium.llm.line_dedup import (
    common_blocks, drop_repeated_lines, op10_line_dedup, patience, patience_diff, repeated_lines,
    rising_runs,
)

PASSAGE = "this passage of many words is found in more than one document of the corpus"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20), unique=True, max_size=12))
def test_patience_keeps_a_longest_rising_run(others):
    run = patience(list(enumerate(others)))
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(run, run[1:]))
    longest = [1] * len(others)
    for i in range(len(others)):
        longest[i] = 1 + max((longest[j] for j in range(i) if others[j] < others[i]), default=0)
    assert len(run) == max(longest, default=0)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 15), st.sets(st.integers(0, 20), min_size=1, max_size=4)))
def test_alignment_rises_on_both_sides_and_leaves_nothing(places):
    matches = {(rank, other) for other, ranks in places.items() for rank in ranks}
    run = sorted(patience_diff(places))
    assert set(run) <= matches
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(run, run[1:]))
    once = [m for m in matches if len(places[m[1]]) == 1]
    assert len(run) >= len(patience(once))
    covered = set()
    for rank, other, n in common_blocks(places):
        block = {(rank + i, other + i) for i in range(n)}
        assert block <= matches and not block & covered
        covered |= block
    assert covered == matches


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), unique=True, max_size=25))
def test_rising_runs_hold_all_matches(matches):
    runs = rising_runs(matches)
    assert sorted(m for run in runs for m in run) == sorted(matches)
    assert all(a[0] < b[0] and a[1] < b[1] for run in runs for a, b in zip(run, run[1:]))


def test_gaps_between_anchors_are_aligned():
    # b stands twice in the later document, but once between the anchors
    assert sorted(patience_diff({0: {0}, 1: {1, 5}, 2: {2}})) == [(0, 0), (1, 1), (2, 2)]


def test_each_row_of_one_id_loses_its_own_lines(documents):
    docs = documents((1, f"a\n{PASSAGE}"), (2, f"x\n{PASSAGE}"), (2, "totally different words here now\ny"))
    left = sorted(r["text"] for r in drop_repeated_lines(docs).where("doc_id = 2").collect())
    assert left == ["totally different words here now\ny", "x"]


def test_lines_in_another_order_are_no_block(documents):
    docs = documents("one two three\nfour five six", "four five six\none two three")
    assert repeated_lines(docs).count() == 0


def test_blocks_are_equal_runs_of_lines(documents):
    rng = random.Random(9)
    lines = ["a", "b b", "d d d", "f f f f f", "g g g g g g", "h h h h h"]
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(12))) for _ in range(60)]
    own = {i: text.split("\n") if text else [] for i, text in enumerate(texts)}
    found = repeated_lines(documents(*texts)).collect()
    assert found
    for r in found:
        for b in r["blocks"]:
            assert b["other"] < r["doc_id"]
            run = own[r["doc_id"]][b["rank"] : b["rank"] + b["windows"]]
            assert run == own[b["other"]][b["other_rank"] : b["other_rank"] + b["windows"]]


def test_common_blocks_go_from_the_later_document(documents):
    docs = documents(
        f"first\n{PASSAGE}\nlast", f"own words\n\n  {PASSAGE.upper()}\nmore", f"{PASSAGE}\nfirst",
        f"{PASSAGE}\nunlike\n{PASSAGE}", "", None, "first", f"first\n{PASSAGE}",
    )
    left = {r["doc_id"]: r for r in drop_repeated_lines(docs).collect()}
    assert left[0]["text"] == f"first\n{PASSAGE}\nlast"
    assert left[1]["text"] == "own words\n\nmore" and left[1]["n_chars"] == len(left[1]["text"])
    assert left[2]["text"] == "first"  # on the other side of its neighbour: no block with it
    assert left[3]["text"] == "unlike"
    assert left[4]["text"] == "" and left[5]["text"] is None
    assert left[6]["text"] == "first"  # too short to count on its own
    assert 7 not in left  # nothing of it is left


def test_awkward_rows(clashing):
    found = {r["doc_id"]: r for r in repeated_lines(clashing).collect()}
    assert None not in found and 3 not in found
    left = drop_repeated_lines(clashing)
    assert left.columns == clashing.columns
    assert left.count() == clashing.count()  # the long texts differ in their only line
    assert drop_repeated_lines(clashing.limit(0)).count() == 0


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seen = seen_lines(texts)
    found = op10_line_dedup(spark, sf_dir).collect()
    assert len(found) == len(texts) and any(r["n_lines_removed"] for r in found)
    for r in found:
        kept = [" ".join(blank_words(line)) for line in r["text"].split("\n")]
        left = [line for line in texts[r["doc_id"]].split("\n")]
        gone = {" ".join(blank_words(line)) for line in left} - set(kept)
        assert gone <= seen[r["doc_id"]]
        assert not [line for line in kept if len(line.split()) >= 5 and line in seen[r["doc_id"]]]


def test_lines_of_several_documents_make_no_block(documents):
    docs = documents("yes\nown", "no\nown words", "so it is\nhere", "yes\nno\nso it is\nyes\nno")
    assert repeated_lines(docs).count() == 0


def test_neighbours_count_on_both_sides(documents):
    # the earlier document has the lines, but apart or in another order
    docs = documents("one two\nthree four\nx\nfive", "three four\none two\nfive")
    assert repeated_lines(docs).count() == 0


def test_block_whose_lines_come_from_several_documents(documents):
    docs = documents("a b", "c d", "e", "new\na b\n\nc d\ne", "own\nA  B\nc d\n\ne\nmore")
    found = {r["doc_id"]: r for r in repeated_lines(docs).collect()}
    assert set(found) == {4} and sorted(found[4]["gone"]) == [1, 2, 4]
    assert (found[4]["n_lines"], found[4]["n_words"], found[4]["n_earlier"]) == (3, 5, 1)


def test_blocks_equal_all_pairs(documents):
    rng = random.Random(5)
    lines = ["", "a", "b", "c c", "d d d", "e e e e", "f f f f f", "g g g g g g"]
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(9))) for _ in range(80)]
    want = reference.common_blocks(dict(enumerate(texts)))
    found = {r["doc_id"]: set(r["gone"]) for r in repeated_lines(documents(*texts)).collect()}
    assert found == {i: gone for i, gone in want.items() if gone} and len(found) > 20
    left = {r["doc_id"]: r["text"] for r in drop_repeated_lines(documents(*texts)).collect()}
    for i, text in left.items():
        kept = [line for at, line in enumerate(texts[i].split("\n")) if at not in want[i]]
        assert text == "\n".join(kept)
