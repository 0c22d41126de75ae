import random

from hypothesis import given, settings
from hypothesis import strategies as st
from reference import contamination, letter_words

from scriptorium.llm.decontaminate import (
    Automaton, contaminated_spans, decontaminate, op4_decontaminate,
)

ITEMS = "item_id long, text string"


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.lists(st.integers(0, 2), max_size=9), max_size=4),
    st.lists(st.integers(0, 2), max_size=25), st.integers(2, 5),
)
def test_automaton_finds_all_windows(items, words, window):
    numbered = list(enumerate(items))
    automaton = Automaton(numbered, window)
    automaton.fill(numbered)
    found = set()
    for end, size, ids in automaton.walk(words):
        found |= {(end, size, i) for i in ids}
    want = set()
    for item, own in numbered:
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[i : i + size]:
                    want.add((at + size, size, item))
    assert found == want


def test_equals_all_windows(documents, table):
    rng = random.Random(2)
    items = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 25))) for _ in range(12)]
    texts = [" ".join(rng.choice("abcdE.") for _ in range(rng.randint(0, 80))) for _ in range(50)]
    benchmark = table(ITEMS, *enumerate(items), (99, None), (None, "a b c"))
    want = contamination(dict(enumerate(texts)), enumerate(items))
    for shard_words in (1_000_000, 10):
        found = contaminated_spans(documents(*texts), benchmark, shard_words=shard_words).collect()
        assert len(found) == len(texts)
        for r in found:
            hit = sum(s["end"] - s["start"] for s in r["spans"])
            assert (r["n_words"], hit, r["items"]) == want[r["doc_id"]], (shard_words, r)


def test_spans_are_cut_and_covered_documents_go(documents, table):
    item = "the Quick brown fox jumps over the lazy dog again today"
    benchmark = table(ITEMS, (1, item))
    before, after = " ".join(["é"] * 12), " ".join(["ñ"] * 12)
    docs = documents(f"{before} {item.upper()}! {after}", f"x {item} y", before, None)
    left = {r["doc_id"]: r for r in decontaminate(docs, benchmark).collect()}
    assert set(left) == {0, 2, 3}
    assert left[0]["text"] == f"{before} ! {after}" and left[0]["n_chars"] == len(left[0]["text"])
    assert left[2]["text"] == before and left[3]["text"] is None
    assert contaminated_spans(decontaminate(docs, benchmark), benchmark).where("size(spans) > 0").count() == 0


def test_awkward_rows(clashing, table):
    benchmark = table(ITEMS, (1, "one two"), (2, ""), (3, "no id here"))
    found = contaminated_spans(clashing, benchmark).collect()
    assert len(found) == clashing.count()
    assert {r["doc_id"] for r in found if r["spans"]} == {3, 4, None}
    assert decontaminate(clashing, benchmark).columns == clashing.columns
    assert decontaminate(clashing, table(ITEMS)).count() == clashing.count()
    assert contaminated_spans(clashing.limit(0), benchmark).count() == 0


def test_query(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()
    texts = {r["doc_id"]: r["text"] for r in read("documents")}
    want = contamination(texts, [(r["item_id"], r["text"]) for r in read("benchmark")])
    found = op4_decontaminate(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in found} == {
        i: (n, hit, len(items), hit > 0) for i, (n, hit, items) in want.items()
    }
    assert any(r["contaminated"] for r in found) and letter_words("É-É ") == ["É", "É"]
