"""Key phrases against a plain Python version."""

import math
import random
import re
import statistics
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import keyphrases
from scriptorium.operators.keyphrases import key_phrases, scored_phrases
from scriptorium.plans import fixtures as fx

SCHEMA = "doc_id long, text string, term string, score string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(text):
    sentences = [w for s in re.split(r"[.!?\n]+", text or "") if (w := re.findall(r"[^\W\d_]+", s))]
    seen = defaultdict(list)
    for number, words in enumerate(sentences):
        low = [w.lower() for w in words]
        for i, word in enumerate(words):
            left, right = low[i - 1] if i else None, low[i + 1] if i + 1 < len(low) else None
            seen[low[i]].append((number, i, word, left, right))
    if not seen:
        return {}
    counts = [len(v) for v in seen.values()]
    most, mean, deviation = max(counts), statistics.fmean(counts), statistics.pstdev(counts)
    score = {}
    for term, found in seen.items():
        tf = len(found)
        capital = sum(i > 0 and w[0] != w[0].lower() for _, i, w, _, _ in found)
        acronym = sum(len(w) > 1 and w == w.upper() != w.lower() for _, _, w, _, _ in found)
        casing = max(capital, acronym) / (1 + math.log(tf))
        position = math.log(math.log(3 + statistics.median(n for n, *_ in found))) + 1
        variety = 0
        for side in (3, 4):
            near = [f[side] for f in found if f[side] is not None]
            variety += len(set(near)) / len(near) if near else 0
        context = 1 + variety * tf / most
        spread = len({n for n, *_ in found}) / len(sentences)
        frequency = tf / (mean + deviation)
        score[term] = context * position / (casing + frequency / context + spread / context)
    phrases = Counter()
    for words in sentences:
        low = [w.lower() for w in words]
        for n in (1, 2, 3):
            for i in range(len(low) - n + 1):
                run = low[i : i + n]
                if len(run[0]) >= 3 and len(run[-1]) >= 3:
                    phrases[" ".join(run)] += 1
    out = {}
    for phrase, n in phrases.items():
        own = [score[w] for w in phrase.split()]
        out[phrase] = math.prod(own) / (n * (1 + sum(own)))
    return out


def best(scores, k=5):
    taken = []
    for score, phrase in sorted((round(s, 6), p) for p, s in scores.items()):
        if len(taken) < k and all(
            distance(p, phrase) > max(len(p), len(phrase)) * 0.2 + 1e-9 for _, p in taken
        ):
            taken.append((score, phrase))
    return taken


TEXT = (
    "The Data Engine reads old tables. A data engine is no wonder! NASA uses the data engines, "
    "and Data Engine tables are large.\nSmall tables are read by NASA too"
)


def test_scores_equal_plain_python(table):
    found = scored_phrases(table(SCHEMA, (1, TEXT, "clash", "clash"))).collect()
    want = plain(TEXT)
    assert {r["phrase"] for r in found} == want.keys() and len(want) > 30
    assert all(abs(r["score"] - want[r["phrase"]]) < 2e-6 for r in found)
    assert "data engine" in {p for _, p in best(want)}


def test_key_phrases_of_a_corpus(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    found = {}
    for r in sorted(key_phrases(docs).collect()):
        found.setdefault(r["doc_id"], []).append((r["score"], r["phrase"]))
    checked = 0
    for row in docs.where("doc_id < 60 AND length(text) < 3000").collect():
        want, own = best(plain(row["text"])), found.get(row["doc_id"], [])
        assert len(own) == len(want)
        for (a, p), (b, q) in zip(own, want):
            assert abs(a - b) < 2e-6 and (p == q or abs(a - b) < 2e-6)
        checked += own == want
    assert checked > 20


def test_near_equal_phrases_are_taken_once(table, rows):
    docs = table(SCHEMA, (1, "Elephants. Elephant. Elephants run. Tiger", "x", "x"))
    phrases = [r[2] for r in rows(key_phrases(docs))]
    assert sum(p in ("elephant", "elephants") for p in phrases) == 1 and "tiger" in phrases


def test_awkward_texts(table):
    docs = table(SCHEMA, *((i, t, "x", "x") for i, t in enumerate([None, "", " .!?", "a b of", "12 34", "ab " * 50])),
                 (None, "nobody owns this", "x", "x"))
    assert key_phrases(docs).count() == 0
    long = table(SCHEMA, (1, "word other " * 20_000, "x", "x"))
    assert len(key_phrases(long).collect()) == 5
    assert key_phrases(docs.limit(0)).count() == 0


def test_phrases_of_a_document_are_never_rows(spark, sf_dir):
    """Rows of all words and phrases, counted and sorted, took over 20 times the CPU time."""
    plan = key_phrases(fx.documents(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Aggregate", "Window", "Sort", "Generate")), plan
    assert "hashpartitioning(doc_id" in plan


def batch_of(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])


def found_in(texts, monkeypatch, size):
    monkeypatch.setattr(keyphrases, "SLICE_BYTES", size)
    whole = batch_of(["left out", *texts, "left out"]).slice(1, len(texts))
    run = keyphrases._best(5, 3, 3, 0.8)
    return [tuple(r.values()) for b in run([whole, whole.slice(0, 0)]) for r in b.to_pylist()]


def test_texts_of_a_batch_are_apart(monkeypatch):
    """Texts that touch in a batch share no word, sentence or count, however the batch is cut."""
    dice = random.Random(4)
    words = "Ort Orte ORTE weiß Straße ΟΔΟΣ Οδος İzmir ǅep 𐐀𐐨𐐀 of a data Engine engines".split()
    texts = [None, "", "\n", " \n "] + [
        "".join(dice.choice(words) + dice.choice([" ", " ", " ", "\n"]) for _ in range(dice.randrange(60))).strip()
        for _ in range(60)
    ]
    whole = found_in(texts, monkeypatch, 1 << 20)
    assert len(whole) > 200 and whole == found_in(texts, monkeypatch, 1) == found_in(texts, monkeypatch, 300)
    for i, text in enumerate(texts, 1):
        own = [(s, p) for d, _, p, s in whole if d == i]
        want = best(plain(text))
        assert [p for _, p in own] == [p for _, p in want]
        assert all(abs(a - b) < 2e-6 for (a, _), (b, _) in zip(own, want))


def test_many_like_phrases_hide_no_other(table):
    """The first few dozen of this text are like its best one."""
    alike = [f"elephant{a}{b}" for a in "bcdfgh" for b in "bcdfghjklm"]
    text = ". ".join([w for w in alike for _ in range(9)] + ["tiger", "bird", "horse", "mouse"])
    found = [(r["score"], r["phrase"]) for r in sorted(key_phrases(table(SCHEMA, (1, text, "x", "x"))).collect())]
    want = best(plain(text))
    assert len(want) == 5 and [p for _, p in found] == [p for _, p in want]


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_runs_of_other_lengths(table, rows, longest):
    docs = table(SCHEMA, (1, TEXT, "x", "x"))
    longer, own = ({r[1]: r[1:] for r in rows(scored_phrases(docs, longest=n))} for n in (4, longest))
    assert own and own == {p: r for p, r in longer.items() if len(p.split()) <= longest}


def test_ids_of_any_kind_and_none_missing(spark, rows):
    docs = spark.createDataFrame([("a", TEXT), ("b", "tiger"), ("c", None), (None, TEXT)], "doc_id string, text string")
    found = key_phrases(docs)
    assert found.dtypes == [("doc_id", "string"), ("rank", "bigint"), ("phrase", "string"), ("score", "double")]
    assert [r[:3] for r in rows(found) if r[0] != "a"] == [("b", 1, "tiger")]
    assert [r[1] for r in rows(found) if r[0] == "a"] == [1, 2, 3, 4, 5]


def test_distance_and_order_of_numbers():
    dice = random.Random(5)
    for _ in range(500):
        a, b = ("".join(dice.choices("abcß ", k=dice.randrange(90 if dice.random() < 0.1 else 9))) for _ in "ab")
        assert keyphrases.distance(a, b) == distance(a, b)
    for most in (5, 1 << 61):
        keys = np.array([dice.randrange(5) * (most // 5) for _ in range(99)])
        order, first = keyphrases._groups(keys)
        assert order.tolist() == np.argsort(keys, kind="stable").tolist()
        assert keys[order[first]].tolist() == sorted(set(keys.tolist()))


def test_scores_round_as_sql_rounds(spark):
    values = [0.0000005, 0.0000015, 0.0000025, 1.0000005, 2.4999995, 0.1234565, 1234.5678905, 7e15, 3e9 + 0.0000005]
    values += [i / 1e6 + 5e-7 for i in range(500)] + [random.Random(6).random() * 9 for _ in range(500)]
    sql = spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", keyphrases.DIGITS))
    assert keyphrases._rounded(np.array(values)).tolist() == [r[0] for r in sql.collect()]
