"""Checks, balance, splits and overlap scores of training records."""

import random
import time

from hypothesis import given
from hypothesis import strategies as st

from scriptorium.operators import datasets
from scriptorium.operators.keywords import word_counts

TURNS = "conv_id long, turn long, role string, text string"


def test_reasons_against_records(table, rows):
    records = table(
        TURNS, (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "a"), (3, 0, "bot", "b"),
        (3, 1, None, "c"), (3, 2, "user", " "), (3, 3, "user", None), (0, 9, "user", "a"),
    )
    found = datasets.validate_records(records, ["conv_id", "turn"])
    assert dict((tuple(r[:2]), r[2]) for r in rows(found, "conv_id", "turn", "reason")) == {
        (0, 9): "", (1, 0): "duplicate", (2, 0): "duplicate", (2, 1): "", (3, 0): "unknown_role",
        (3, 1): "unknown_role", (3, 2): "no_text", (3, 3): "no_text",
    }
    assert datasets.validate_records(table(TURNS), ["conv_id", "turn"]).count() == 0


def test_every_class_gets_as_many_rows_as_the_smallest(table, rows):
    labels = table("doc_id long, label long", *((i, int(i % 4 == 0)) for i in range(40)))
    assert rows(datasets.label_balance(labels, "label")) == [(0, 30, 0.75, 3.0), (1, 10, 0.25, 1.0)]
    chosen = rows(datasets.balanced(labels, "doc_id", "label"))
    assert len(chosen) == 20 and sum(label for _, label in chosen) == 10


def test_splits_follow_the_key(table):
    records = table("conv_id long, turn long", *((i, t) for i in range(2000) for t in (0, 1)))
    found = datasets.split_80_10_10(records, "conv_id").collect()
    of = {}
    for r in found:
        of.setdefault(r.conv_id, set()).add(r.split)
    assert all(len(s) == 1 for s in of.values())
    shares = [sum(s == {name} for s in of.values()) / 2000 for name in ("train", "validation", "test")]
    assert abs(shares[0] - 0.8) < 0.04 and min(shares[1:]) > 0.06


def test_overlap_counts_repeats_as_often_as_both_have_them(table, rows):
    pairs = table("id long, candidate string, reference string", (1, "The cat the cat", "the cat sat"), (2, "", None))
    assert rows(datasets.rouge_scores(pairs, ["id"], 1)) == [(1, 4, 3, 2, 0.571429), (2, 0, 0, 0, 0.0)]
    assert rows(datasets.rouge_scores(pairs, ["id"], 2)) == [(1, 3, 2, 1, 0.4), (2, 0, 0, 0, 0.0)]


def test_pairs_are_neighbouring_turns_of_one_conversation(table, rows):
    turns = table(
        TURNS, (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (2, 1, "assistant", "c"),
        (1, 3, "user", "q2"), (1, 4, "assistant", "a2"),
    )
    found = datasets.answer_pairs(turns)
    assert rows(found, "turn", "reference", "candidate") == [(1, "q", "a"), (4, "q2", "a2")]


def test_words_are_counted_by_document(table, rows):
    docs = table("doc_id long, text string", (1, "b a B ab a b"), (2, ""), (3, None), (4, "x"))
    assert rows(word_counts(docs)) == [(1, "a", 2), (1, "ab", 1), (1, "b", 3), (4, "x", 1)]


def test_repeated_keys_blanks_and_line_feeds(table, rows):
    records = table(
        TURNS + ", _n string", *((*r, "clash") for r in (
            (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"),
            (2, 0, "user", "\t"), (2, 1, "user", "\u00a0\u2003\n"),
            (3, 0, "a\nb", "c"), (3, 1, "a", "b\nc"), (4, 0, None, "x"), (4, 1, "", "x"),
        )),
    ).drop("_n")
    found = datasets.validate_records(records, ["conv_id", "turn"], ("user", "a\nb", "a", ""))
    assert rows(found, "conv_id", "turn", "text", "reason") == sorted([
        (1, 0, "a", ""), (1, 0, "a", "duplicate"), (1, 0, "a", "duplicate"), (1, 0, "b", ""),
        (2, 0, "\t", "no_text"), (2, 1, "\u00a0\u2003\n", "no_text"), (3, 0, "c", ""),
        (3, 1, "b\nc", ""), (4, 0, "x", "unknown_role"), (4, 1, "x", ""),
    ], key=repr)


def test_rows_of_equal_keys_that_differ_elsewhere(table, rows):
    records = table(TURNS + ", source string", *((1, 0, "user", "a", s) for s in ("p", "q", "q", "r")))
    found = datasets.validate_records(records, ["conv_id", "turn"])
    assert sorted(r.reason for r in found.collect()) == ["", "duplicate", "duplicate", "duplicate"]


def by_table(one, other):
    row = [0] * (len(one) + 1)
    for word in other:
        last = 0
        for j, own in enumerate(one, 1):
            last, row[j] = row[j], last + 1 if own == word else max(row[j], row[j - 1])
    return row[-1]


@given(st.lists(st.sampled_from("abcd"), max_size=90), st.lists(st.sampled_from("abcde"), max_size=90))
def test_longest_common_subsequence_equals_the_table(one, other):
    assert datasets.longest_common(one, other) == by_table(one, other)


def test_longest_common_subsequence_of_long_texts():
    rng = random.Random(1)
    one, other = ([f"w{rng.randrange(5000)}" for _ in range(50_000)] for _ in range(2))
    start = time.time()
    assert 0 < datasets.longest_common(one, other) < 50_000
    assert datasets.longest_common(one, one) == 50_000
    assert time.time() - start < 20


def test_scores_by_longest_common_subsequence(table, rows):
    pairs = table(
        "id long, candidate string, reference string", (1, "The cat the cat", "the cat sat, cat"), (2, "", None),
        (2, None, "a"),
    )
    assert rows(datasets.rouge_l_scores(pairs, ["id"])) == [
        (1, 4, 4, 3, 0.75), (2, 0, 0, 0, 0.0), (2, 0, 1, 0, 0.0),
    ]
