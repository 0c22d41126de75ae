import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from reference import near_groups
from test_near_dedup import variants

from scriptorium.llm.ngram_join import ngram_join, product_links, spanning

COLUMNS = ("doc_id", "n_shingles", "component_id")


def sets_of(lists):
    return [np.array(sorted(x), np.uint64) for x in lists]


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.sets(st.integers(0, 30), max_size=30), min_size=1, max_size=12),
    st.integers(0, 12), st.sampled_from([1, 50, 80, 100]), st.sampled_from([1, 3, 64]),
)
def test_product_equals_all_pairs(sets, cut, percent, slab):
    side = np.array([int(i >= cut) for i in range(len(sets))])
    two = 0 < cut < len(sets)
    found = set(map(frozenset, zip(*(x.tolist() for x in product_links(sets_of(sets), side, percent, slab)))))
    want = {
        frozenset((i, j)) for i in range(len(sets)) for j in range(i)
        if (not two or side[i] != side[j]) and (sets[i] or sets[j])
        and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    }
    assert found == want


def test_spanning_links_connect_the_same():
    a, b = np.array([0, 1, 2, 4]), np.array([1, 2, 0, 5])
    assert spanning(6, a, b) == [(0, 1), (1, 2), (4, 5)]


@pytest.mark.parametrize("options", [{}, {"block": 8, "slab": 64, "small_bucket": 4}])
def test_components_equal_all_pairs(documents, rows, options):
    texts = variants(60, 5) + variants(40, 6, words=12, edits=3) + variants(30, 7, 400, 60)
    texts += ["a b", "A  B", "b a", "c"] + [" ".join(t.split()[:50]) for t in variants(20, 8)]
    want = [(i, n, c) for i, (n, c) in near_groups(dict(enumerate(texts)), 80).items()]
    assert rows(ngram_join(documents(*texts), **options), *COLUMNS) == sorted(want, key=repr)


def test_threshold_is_inclusive(documents, rows):
    # 16 common of 20: exactly 80 of 100
    a, b = (" ".join(f"w{i}" for i in range(n)) for n in (24, 20))
    short = " ".join(f"w{i}" for i in range(19))
    assert rows(ngram_join(documents(a, b, short)), *COLUMNS) == [(0, 20, 0), (1, 16, 0), (2, 15, 0)]
    assert rows(ngram_join(documents(a, short)), *COLUMNS) == [(0, 20, 0), (1, 15, 1)]


def test_texts_of_one_id_share_a_component(documents, rows):
    rng = random.Random(1)
    x, y, z = (" ".join(f"{rng.randrange(999)}" for _ in range(30)) for _ in range(3))
    docs = documents((1, x), (2, x), (2, y), (3, y), (4, z), (5, ""), (5, z))
    assert rows(ngram_join(docs), "doc_id", "component_id") == [
        (1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 5),
    ]


def test_awkward_rows(clashing):
    found = ngram_join(clashing).collect()
    assert len(found) == clashing.count()
    of = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in found}
    assert of[0, 0] == 0 and of[1, 0] == 1 and of[3, 1] == of[4, 1] == 3
    assert of[None, 1] is None and {c for (i, _), c in of.items() if i in (5, 6)} == {5}
    assert ngram_join(clashing.limit(0)).count() == 0
