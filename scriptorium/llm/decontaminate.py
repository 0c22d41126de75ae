"""Benchmark passages in documents, found with a generalised suffix automaton of the items.

The automaton of all item texts, over words, has at most two states a word. A document's words
run through it once; at each word the state and the length of the longest match that ends
there are known, so every window of ``WINDOW`` words (or whole shorter item) that occurs is
seen, in time linear in the text. Words that occur in no item cut the text beforehand, and only
stretches long enough for a window are walked.

The items are cut into automata of at most ``SHARD_WORDS`` words each, a fixed size that is sent
to the tasks; a larger benchmark takes one pass over the texts per automaton, and the hits
are then joined per document. With one automaton there is no exchange at all.

Edge cases: null text has no words and no hits; null items and items without words match
nothing; items with equal texts all count. Rows of one doc_id are searched one by one. An empty
benchmark hits nothing, an empty table gives an empty one.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.llm.tables import load
from scriptorium.llm.words import (
    NO_LETTER, lowered, pieces, span_hashes, text_bytes, word_spans,
)

WINDOW = 10
SHARD_WORDS = 1_000_000
MOST_COVERAGE = 0.5


class Automaton:
    """Suffix automaton of many word sequences, with the items of every long enough state."""

    def __init__(self, items, window=WINDOW):
        """``items``: pairs of id and list of word numbers."""
        self.window = window
        self.next, self.link, self.length = [{}], [-1], [0]
        self.items = {}
        self.short = {}
        whole = {}
        for item, words in items:
            if words:
                whole.setdefault(tuple(words), []).append(item)
        self.least = window
        for words, ids in whole.items():
            self._add(words, ids)
            if len(words) < window:
                self.least = min(self.least, len(words))
        for words, ids in whole.items():
            if len(words) < window:
                self._end(words, ids)
        self._inherit()

    def _extend(self, last, word):
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, word, known)
        state = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at != -1:
            other = self.next[at][word]
            fits = self.length[other] == self.length[at] + 1
            self.link[state] = other if fits else self._clone(at, word, other)
        return state

    def _state(self, length, following, link):
        self.length.append(length)
        self.next.append(following)
        self.link.append(link)
        return len(self.length) - 1

    def _clone(self, at, word, other):
        copy = self._state(self.length[at] + 1, dict(self.next[other]), self.link[other])
        self.link[other] = copy
        while at != -1 and self.next[at].get(word) == other:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _add(self, words, ids):
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _end(self, words, ids):
        state = 0
        for word in words:
            state = self.next[state][word]
        self.short.setdefault(state, []).append((len(words), ids))

    def _inherit(self):
        """For each state, the nearest state on its suffix path that ends a short item."""
        self.above = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[state]
            self.above[state] = up if up in self.short else self.above[up]

    def fill(self, items):
        """Record for each state with a window the items it occurs in."""
        for item, words in items:
            state = length = 0
            for word in words:
                state, length = self.step(state, length, word)
                if length >= self.window:
                    at = self.at_window(state)
                    own = self.items.setdefault(at, [])
                    if not own or own[-1] != item:
                        own.append(item)

    def step(self, state, length, word):
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0

    def at_window(self, state):
        """The state of the last ``window`` words of a match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def walk(self, words):
        """Matches in a stretch of words: ``(end, length, items)`` of each window found."""
        state = length = 0
        for end, word in enumerate(words, 1):
            state, length = self.step(state, length, word)
            if length >= self.window:
                yield end, self.window, self.items[self.at_window(state)]
            at = state if state in self.short else self.above[state]
            while at > 0:
                for size, ids in self.short.get(at, ()):
                    if size <= length:
                        yield end, size, ids
                at = self.above[at]


def _words(column):
    data, offsets = text_bytes(column)
    data = lowered(data)
    starts, ends, first = word_spans(data, offsets, NO_LETTER)
    return span_hashes(data, starts, ends), first, starts, ends, offsets


def _automaton(ids, texts, window):
    """``(sorted vocabulary, automaton)`` of the items."""
    hashes, first, *_ = _words(pa.array(texts, pa.string()))
    vocabulary, numbers = np.unique(hashes, return_inverse=True)
    numbers = numbers.tolist()
    items = [(i, numbers[a:b]) for i, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist())]
    automaton = Automaton(items, window)
    automaton.fill(items)
    return vocabulary, automaton


def _stretches(numbers, first, least):
    """Ranges of at least ``least`` consecutive known words within one text."""
    known = numbers >= 0
    inside = np.zeros(len(known) + 2, bool)
    inside[1:-1] = known
    begins = inside[1:] & ~inside[:-1]
    closes = inside[:-1] & ~inside[1:]
    cuts = first[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(known))]
    joint = cuts[inside[cuts] & inside[cuts + 1]]
    begins[joint] = closes[joint] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes)
    long = ends - starts >= least
    return starts[long].tolist(), ends[long].tolist()


def _merged(found):
    """Sorted, disjoint ``[start, end)`` ranges of words."""
    out = []
    for start, end in sorted(found):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


SPANS = pa.list_(pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("from", pa.int32()), ("to", pa.int32()),
]))
FOUND = (
    "doc_id long, print long, n_words long, items array<string>, "
    "spans array<struct<start:int,end:int,from:int,to:int>>"
)


def _search(ids, texts, window):
    def run(batches):
        vocabulary, automaton = _automaton(ids, texts, window)
        for batch in pieces(batches):
            hashes, first, starts, ends, offsets = _words(batch["text"])
            numbers = np.full(len(hashes), -1)
            if len(vocabulary):
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                numbers = np.where(vocabulary[at] == hashes, at, -1)
            hits = {}
            for a, b in zip(*_stretches(numbers, first, automaton.least)):
                for end, size, items in automaton.walk(numbers[a:b].tolist()):
                    hits.setdefault(a, []).append((a + end - size, a + end, items))
            items = [set() for _ in range(batch.num_rows)]
            spans = [[] for _ in range(batch.num_rows)]
            for a, found in hits.items():
                text = int(np.searchsorted(first, a, "right")) - 1
                items[text].update(str(i) for _, _, own in found for i in own)
                for s, e in _merged((s, e) for s, e, _ in found):
                    spans[text].append({
                        "start": s - first[text], "end": e - first[text],
                        "from": starts[s] - offsets[text], "to": ends[e - 1] - offsets[text],
                    })
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["print"], pa.array(np.diff(first)),
                 pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                 pa.array(spans, SPANS)],
                ["doc_id", "print", "n_words", "items", "spans"],
            )

    return run


def shards(benchmark, shard_words=SHARD_WORDS):
    """Lists ``(ids, texts)`` of items with at most ``shard_words`` words in total, or one item.

    Items get their shard from a running sum over hash buckets, so no task sorts them all;
    the driver holds one shard at a time.
    """
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where("text is not null and item_id is not null")
    size = F.length("text") / 2 + 1  # no fewer than its words
    buckets = (
        items.groupBy(F.pmod(F.xxhash64("item_id", "text"), F.lit(1024)).alias("bucket"))
        .agg(F.sum(size).alias("size"))
    )
    running = F.sum("size").over(Window.orderBy("bucket"))  # 1,024 rows at most
    placed = {}
    for row in buckets.select("bucket", running.alias("upto")).collect():
        placed.setdefault(int(row["upto"] // shard_words), []).append(row["bucket"])
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(1024))
    for chosen in placed.values():
        rows = items.where(bucket.isin(chosen)).collect()
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def _union(batches):
    """Items and spans that several automata found in one text, as one list each."""
    for batch in batches:
        items, spans = [], []
        for own, ranges in zip(batch["items"].to_pylist(), batch["spans"].to_pylist()):
            items.append(sorted({i for part in own for i in part}))
            words = _merged((x["start"], x["end"]) for part in ranges for x in part)
            bytes_ = {x["start"]: x["from"] for part in ranges for x in part}
            to = {x["end"]: x["to"] for part in ranges for x in part}
            spans.append([
                {"start": s, "end": e, "from": bytes_[s], "to": to[e]} for s, e in words
            ])
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["print"], pa.array(items, pa.list_(pa.string())),
             pa.array(spans, SPANS)],
            ["doc_id", "print", "items", "spans"],
        )


def contaminated_spans(docs, benchmark, window=WINDOW, shard_words=SHARD_WORDS):
    """``(doc_id, print, n_words, items, spans)`` per row of ``docs``.

    ``print`` is a hash of the text; a span is a range of words and of UTF-8 bytes.
    """
    texts = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"),
        F.xxhash64(F.col("text").cast("string")).alias("print"),
    )
    parts = [
        texts.mapInArrow(_search(ids, items, window), FOUND)
        for ids, items in shards(benchmark, shard_words)
    ] or [texts.mapInArrow(_search([], [], window), FOUND)]
    if len(parts) == 1:
        return parts[0]
    hits = None
    for part in parts:
        hit = part.where(F.size("spans") > 0)
        hits = hit if hits is None else hits.unionByName(hit)
    hits = hits.dropDuplicates(["doc_id", "print", "items", "spans"]).groupBy("doc_id", "print")
    hits = hits.agg(F.collect_list("items").alias("items"), F.collect_list("spans").alias("spans"))
    merged = hits.mapInArrow(_union, FOUND.replace("n_words long, ", "")).select(
        F.col("doc_id").alias("d"), F.col("print").alias("p"), "items", "spans"
    )
    rows = parts[0].select("doc_id", "print", "n_words")
    same = rows["doc_id"].eqNullSafe(merged["d"]) & (rows["print"] == merged["p"])
    return rows.join(merged, same, "left").select(
        "doc_id", "print", "n_words",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast(dict(merged.dtypes)["spans"])).alias("spans"),
    )


def _hit_words(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))


def _without(text, spans):
    """The text without the bytes of its spans."""
    edges = F.concat(
        F.array(F.lit(0)), F.flatten(F.transform(spans, lambda x: F.array(x["from"], x["to"]))),
        F.array(F.octet_length(text)),
    )
    kept = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.substring(
            text.cast("binary"), F.get(edges, 2 * i) + 1,
            F.get(edges, 2 * i + 1) - F.get(edges, 2 * i),
        ),
    )
    return F.decode(F.aggregate(kept, F.lit(b""), lambda all_, x: F.concat(all_, x)), "UTF-8")


def decontaminate(docs, benchmark, window=WINDOW, most_coverage=MOST_COVERAGE, **options):
    """``docs`` with every span of at least a window removed from the text.

    A row goes altogether if its spans cover ``most_coverage`` of its words or more.
    ``n_chars``, if there, follows the text. Rows without a span stay as they are.
    """
    hits = contaminated_spans(docs, benchmark, window, **options).where(F.size("spans") > 0)
    hits = hits.dropDuplicates(["doc_id", "print"]).select(
        F.struct(
            "doc_id", "print", "n_words", "spans", _hit_words(F.col("spans")).alias("n_hit")
        ).alias("_hit")
    )
    hit = F.col("_hit")
    same = F.col("doc_id").cast("long").eqNullSafe(hit["doc_id"]) & (
        F.xxhash64(F.col("text").cast("string")) == hit["print"]
    )
    rows = docs.join(hits, same, "left").where(
        hit.isNull() | (hit["n_hit"] < hit["n_words"] * float(most_coverage))
    )
    text = F.when(hit.isNull(), F.col("text")).otherwise(_without(F.col("text"), hit["spans"]))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        n_chars = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        rows = rows.withColumn("n_chars", F.when(hit.isNull(), F.col("n_chars")).otherwise(n_chars))
    return rows.select(*docs.columns)


def digest(items):
    """Lower-case hex SHA-256 of the comma-joined sorted strings."""
    return F.sha2(F.array_join(items, ","), 256)


def op4_decontaminate(spark, sf_dir):
    found = contaminated_spans(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    hit = _hit_words(F.col("spans"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        digest(F.col("items")).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4_SQL = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, w, least({WINDOW}, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)
), windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS passage
  FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items WHERE k > 0)
), docs AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), places AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS passage
  FROM (SELECT d.doc_id, d.w, s.k, unnest(range(1, len(d.w) - s.k + 2)) AS i FROM docs d, (SELECT DISTINCT k FROM windows) s)
), hits AS (
  SELECT p.doc_id, p.k, p.i, w.item FROM places p JOIN windows w ON p.k = w.k AND p.passage = w.passage
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""
