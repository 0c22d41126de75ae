"""Blocks of lines common with an earlier document, removed from the later one.

1. Every line is hashed (blank runs and A-Z case do not matter). The units of the alignment are
   windows: the shortest run of neighbouring lines from a line on, and up to it, with
   ``LEAST_BLOCK`` words; lines without words part nothing, and a line of that many words is a
   window by itself. So a unit is never a lone short line, and equal windows are a common block.
2. A window's rare line is its first place in the corpus: the earliest document that has it and
   the line where it begins there. Every other document that has it is paired with that one, so
   links grow with the lines and never with their pairs, and every window that any earlier document
   has is among those of some pair.
3. Each pair is aligned by patience diff: windows that stand once in both documents are anchors,
   the longest run of them that rises on both sides stands fast, and the gaps between are aligned in the
   same way. What did not align is dealt by patience into further rising runs, so a passage
   that moved, or stands twice, is aligned too, each time in its own direction.
4. Aligned windows that are neighbours on both sides make one block; its lines go from the later
   document. A document that is left without words goes altogether.

The texts are exchanged once at most, when lines are cut; an alignment reads the places of common
windows only.

Edge cases: null and empty texts have no lines and stay as they are; so do lines that repeat
within one document only; rows of one doc_id are not held against each other, and each loses the
lines of its own text only; rows without doc_id are neither changed nor compared; an empty table
gives an empty one. Lines that become neighbours by a cut do not count as neighbours. A block
from last to first is no common block.
"""

import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scriptorium.llm.tables import load
from scriptorium.llm.words import (
    U64, lowered, mix, pieces, span_hashes, text_bytes, word_spans,
)
from scriptorium.operators.skew import look_up

LEAST_BLOCK = 5

WINDOWS = "doc_id long, print long, window long, starts array<int>, lines array<long>"


def _hashed_lines(column):
    """``(text, line hash, words, position)`` of each line with words, in order.

    ``position`` counts newlines before the line.
    """
    data, offsets = text_bytes(column)
    data = lowered(data)
    starts, ends, _ = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    newlines = np.concatenate([[0], np.cumsum(data == 10)])
    text = np.searchsorted(offsets, starts, "right") - 1
    position = newlines[starts] - newlines[offsets[text]]
    new = np.ones(len(starts), bool)
    new[1:] = (text[1:] != text[:-1]) | (position[1:] != position[:-1])
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(starts)))
    place = np.arange(len(starts)) - np.repeat(at, sizes)
    with np.errstate(over="ignore"):
        spread = mix(words + mix(place.astype(U64)))
        lines = mix(np.add.reduceat(spread, at) + sizes.astype(U64)) if len(at) else spread
    return text[at], lines, sizes, position[at]


def _windows(text, sizes, least_block):
    """``(first, last)`` lines of the windows: from each line on, and up to each line."""
    words = np.concatenate([[0], np.cumsum(sizes)])
    here = np.arange(len(text))
    ends = np.searchsorted(words, words[:-1] + least_block) - 1
    starts = np.searchsorted(words, words[1:] - least_block, "right") - 1
    opens = ends < np.searchsorted(text, text, "right")
    closes = starts >= np.searchsorted(text, text)
    first = np.concatenate([here[opens], starts[closes]])
    last = np.concatenate([ends[opens], here[closes]])
    return np.unique(np.stack([first, last]), axis=1)


def _lines(least_block):
    def run(batches):
        for batch in pieces(batches):
            text, lines, sizes, position = _hashed_lines(batch["text"])
            first, last = _windows(text, sizes, least_block)
            window = np.zeros(len(first), U64)
            with np.errstate(over="ignore"):
                for i in range(least_block):
                    at = np.minimum(first + i, last)
                    following = mix(window * U64(0x9E3779B97F4A7C15) + lines[at])
                    window = np.where(first + i <= last, following, window)
            order = np.lexsort((first, window, text[first]))
            first, last, window = first[order], last[order], window[order]
            new = np.ones(len(first), bool)
            new[1:] = (text[first[1:]] != text[first[:-1]]) | (window[1:] != window[:-1])
            at = np.flatnonzero(new)
            edges = np.concatenate([[0], np.cumsum(last - first + 1)])
            line = np.repeat(first - edges[:-1], last - first + 1) + np.arange(edges[-1])
            rank = first - np.searchsorted(text, text[first])
            of = pa.array(text[first[at]])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(of), batch["print"].take(of),
                    pa.array(window[at].view(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.append(at, len(first)).astype(np.int32)),
                        pa.array(rank.astype(np.int32)),
                    ),
                    pa.ListArray.from_arrays(
                        pa.array(np.append(edges[:-1][at], edges[-1]).astype(np.int32)),
                        pa.array((position[line].astype(np.int64) << 32) | sizes[line]),
                    ),
                ],
                ["doc_id", "print", "window", "starts", "lines"],
            )

    return run


def _print(text):
    """Tells the rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def windows_of(docs, least_block=LEAST_BLOCK):
    """Per text and window: its hash, where it begins among the lines with words, all its lines.

    A line is the newlines before it, shifted left by 32 bits, and its words.
    """
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long"), _print(text).alias("print"), text.alias("text"))
    return texts.where("doc_id is not null").mapInArrow(_lines(least_block), WINDOWS)


def shared_windows(windows):
    """Windows of later documents with the place where the window stands first."""
    first = windows.groupBy("window").agg(
        F.min(F.struct("doc_id", "print", F.col("starts")[0].alias("start"))).alias("place"),
        F.max("doc_id").alias("last"),
    ).where("last > place.doc_id").select("window", "place")
    return look_up(windows, first, ["window"], "doc_id").where("doc_id > place.doc_id")


def patience(matches):
    """The longest run of ``(rank, other rank)`` matches that rises on both sides."""
    matches = sorted(matches, key=lambda m: (m[0], -m[1]))
    tails, ends, back = [], [], []
    for i, (_, other) in enumerate(matches):
        at = bisect.bisect_left(tails, other)
        back.append(ends[at - 1] if at else None)
        tails[at : at + 1] = [other]
        ends[at : at + 1] = [i]
    run, i = [], ends[-1] if ends else None
    while i is not None:
        run.append(matches[i])
        i = back[i]
    return run[::-1]


def patience_diff(places):
    """Aligned ``(rank, other rank)`` of ``{other rank: ranks of the later document}``.

    Only what stands once in a gap can be an anchor of it.
    """
    found = []
    gaps = [sorted((rank, other) for other, ranks in places.items() for rank in ranks)]
    while gaps:
        gap = gaps.pop()
        times = Counter(other for _, other in gap)
        run = patience([m for m in gap if times[m[1]] == 1])
        found += run
        if not run or len(run) == len(gap):
            continue
        parts = [[] for _ in range(len(run) + 1)]
        ranks = [rank for rank, _ in run]
        for rank, other in gap:
            at = bisect.bisect_left(ranks, rank)
            low = run[at - 1][1] if at else -1
            high = run[at][1] if at < len(run) else float("inf")
            if low < other < high and (at == len(run) or rank != ranks[at]):
                parts[at].append((rank, other))
        gaps += [part for part in parts if part]
    return found


def rising_runs(matches):
    """All matches dealt by patience into as few runs as possible that rise on both sides."""
    runs, tails = [], []  # tails are negative and rise
    for rank, other in sorted(matches, key=lambda m: (m[0], -m[1])):
        at = bisect.bisect_right(tails, -other)
        runs[at:at] = [] if at < len(runs) else [[]]
        tails[at : at + 1] = [-other]
        runs[at].append((rank, other))
    return runs


def common_blocks(places):
    """Blocks ``(rank, other rank, windows)`` of one pair of documents, whole or not at all.

    ``places`` tells for each window where it begins in the earlier document and where in the later.
    """
    runs = [sorted(patience_diff(places))]
    done = set(runs[0])
    left = [(r, other) for other, ranks in places.items() for r in ranks if (r, other) not in done]
    out = []
    for run in [*runs, *rising_runs(left)]:
        for rank, other in run:
            if out and (rank, other) == (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]):
                out[-1][2] += 1
            else:
                out.append([rank, other, 1])
    return [tuple(block) for block in out]


def _align(batches):
    for batch in pieces(batches):
        rows = []
        for doc_id, print_, shared in zip(*(batch[c].to_pylist() for c in ("doc_id", "print", "shared"))):
            pairs, lines = {}, {}
            for one in shared:
                place = one["place"]
                pair = pairs.setdefault((place["doc_id"], place["print"]), {})
                pair.setdefault(place["start"], set()).update(one["starts"])
                width = len(one["lines"]) // len(one["starts"])
                for i, start in enumerate(one["starts"]):
                    own = one["lines"][i * width : (i + 1) * width]
                    lines[start] = max(own, lines.get(start, own), key=len)
            blocks = [
                {"rank": rank, "windows": n, "other": other, "other_rank": start}
                for (other, _), places in sorted(pairs.items())
                for rank, start, n in common_blocks(places)
            ]
            gone = {
                line for b in blocks for at in range(b["rank"], b["rank"] + b["windows"])
                for line in lines[at]
            }
            numbers = sorted(line >> 32 for line in gone)
            cut = np.zeros(numbers[-1] + 1, bool)
            cut[numbers] = True
            rows.append({
                "doc_id": doc_id, "print": print_, "n_lines": len(gone),
                "n_words": sum(line & (1 << 32) - 1 for line in gone),
                "n_earlier": len({other for other, _ in pairs}), "gone": numbers,
                "cut": cut.tolist(), "blocks": blocks,
            })
        yield pa.RecordBatch.from_pylist(rows, ARROW_ALIGNED)


ALIGNED = (
    "doc_id long, print long, n_lines int, n_words long, n_earlier int, gone array<int>, "
    "cut array<boolean>, "
    "blocks array<struct<rank:int,windows:int,other:long,other_rank:int>>"
)
ARROW_ALIGNED = pa.schema([
    ("doc_id", pa.int64()), ("print", pa.int64()), ("n_lines", pa.int32()),
    ("n_words", pa.int64()), ("n_earlier", pa.int32()), ("gone", pa.list_(pa.int32())),
    ("cut", pa.list_(pa.bool_())),
    ("blocks", pa.list_(pa.struct([
        ("rank", pa.int32()), ("windows", pa.int32()), ("other", pa.int64()),
        ("other_rank", pa.int32()),
    ]))),
])


def aligned_documents(docs, least_block=LEAST_BLOCK):
    """Per later text: its blocks, the line numbers that go and, as flags, the same (``cut``).

    Only texts that share a block with an earlier document have a row.
    """
    found = shared_windows(windows_of(docs, least_block)).groupBy("doc_id", "print").agg(
        F.collect_list(F.struct("place", "starts", "lines")).alias("shared")
    )
    return found.mapInArrow(_align, ALIGNED)


def repeated_lines(docs, least_block=LEAST_BLOCK):
    """Per later text: the line numbers that go, how many words, from how many documents, blocks."""
    return aligned_documents(docs, least_block).drop("print", "cut")


def cut_lines(docs, least_block=LEAST_BLOCK):
    """``docs`` with the repeated blocks cut from ``text`` and a struct ``_lost``.

    ``_lost`` is null where nothing goes; ``_lost.all`` tells that no word is left.
    """
    gone = aligned_documents(docs, least_block).select(
        F.struct("doc_id", "print", "n_lines", "n_words", "n_earlier", "cut").alias("_gone")
    )
    same = (F.col("doc_id").cast("long") == F.col("_gone.doc_id")) & (
        _print(F.col("text").cast("string")) == F.col("_gone.print")
    )
    rows = docs.join(gone, same, "left")
    hit = F.col("_gone").isNotNull()
    flags = F.col("_gone.cut")
    left = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.coalesce(F.get(flags, i), F.lit(False)))
    rows = rows.withColumn("text", F.when(hit, F.array_join(left, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n_chars = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        rows = rows.withColumn("n_chars", F.when(hit, n_chars).otherwise(F.col("n_chars")))
    empty = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    lost = F.struct("_gone.n_lines", "_gone.n_words", "_gone.n_earlier", empty.alias("all"))
    return rows.select(*docs.columns, F.when(hit, lost).alias("_lost"))


def drop_repeated_lines(docs, least_block=LEAST_BLOCK):
    """``docs`` without repeated blocks of lines; rows left without a word by that go."""
    rows = cut_lines(docs, least_block)
    return rows.where("_lost is null or not _lost.all").select(*docs.columns)


def op10_line_dedup(spark, sf_dir):
    """Every document with its text after the cut and what it lost."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_lines(docs).select(
        "doc_id", "text",
        *(F.coalesce(f"_lost.{n}", F.lit(0)).cast("long").alias(f"{n}_removed")
          for n in ("n_lines", "n_words")),
        F.coalesce("_lost.n_earlier", F.lit(0)).cast("long").alias("n_earlier"),
        (~F.coalesce("_lost.all", F.lit(False))).alias("kept"),
    )

