"""Edits by region against all pairs."""

import random

import pytest

from scriptorium.operators.regions import apply_region_edits, overlaps

BLOCKS = "doc_id long, page_num long, block_no long, bbox array<double>, text string, e_x0 string"
EDITS = "doc_id long, page_num long, seq long, bbox array<double>, text string, _x string"


def box(rng, most):
    x, y = rng.uniform(-most, most), rng.uniform(-most, most)
    return [x, y, x + rng.choice([0, 1, 30, most]) * rng.random(), y + rng.choice([1, 90, most]) * rng.random()]


def meet(a, b):
    return min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])


@pytest.mark.parametrize("most, cell, levels", [(300, 64.0, 8), (5000, 16.0, 3), (1e12, 64.0, 8)])
def test_overlaps_equal_all_pairs(table, rows, most, cell, levels):
    rng = random.Random(int(most))
    blocks = [(rng.randrange(2), rng.randrange(2), i, box(rng, most), f"b{i}", "clash") for i in range(120)]
    edits = [(rng.randrange(2), rng.randrange(2), i, box(rng, most), f"e{i}", "clash") for i in range(60)]
    want = sorted(
        (b[0], b[1], b[2], e[2]) for b in blocks for e in edits
        if b[:2] == e[:2] and all(x[0] < x[2] and x[1] < x[3] for x in (b[3], e[3])) and meet(b[3], e[3])
    )
    found = overlaps(table(BLOCKS, *blocks), table(EDITS, *edits), cell, levels).distinct()
    assert rows(found, "doc_id", "page_num", "block_no", "seq") == sorted(want, key=repr)
    assert len(want) > 10


def test_last_edit_of_each_block_wins(table, rows):
    blocks = table(
        BLOCKS, *((1, 0, i, [0.0, 10.0 * i, 100.0, 10.0 * i + 9], f"b{i}", "x") for i in range(4)),
        (1, 1, 0, None, "none", "x"), (1, 1, 1, [0.0, 0.0], "short", "x"),
    )
    edits = table(
        EDITS, (1, 0, 1, [50.0, 0.0, 60.0, 15.0], "first", "x"), (1, 0, 2, [0.0, 19.0, 5.0, 10.0], "", "x"),
        (1, 0, 3, [0.0, 0.0, 100.0, 100.0], None, "x"), (1, 0, 4, [0.0, 29.0, 9.0, 30.0], "between", "x"),
        (1, 0, 5, [0.0, 0.0, 0.0, 50.0], "flat", "x"), (1, 0, 6, [0.0, float("nan"), 9.0, 9.0], "nan", "x"),
        (1, 1, 7, [0.0, 0.0, 999.0, 999.0], "nothing here", "x"), (2, 0, 8, [0.0, 0.0, 9.0, 9.0], "y", "x"),
    )
    found = apply_region_edits(blocks, edits)
    assert rows(found, "page_num", "block_no", "new_text", "changed") == [
        (0, 0, "first", True), (0, 1, "", True), (0, 2, "b2", False), (0, 3, "b3", False),
        (1, 0, "none", False), (1, 1, "short", False),
    ]
    assert apply_region_edits(blocks, edits.limit(0)).where("changed").count() == 0
    assert apply_region_edits(blocks.limit(0), edits).count() == 0
