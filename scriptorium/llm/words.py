"""Words, shingles and lines of whole texts as NumPy arrays of 64-bit hashes.

Used inside tasks on one Arrow batch at a time. Texts are UTF-8 bytes, upper-case A-Z are
lowered. A word's hash depends on its bytes alone, so it is the same in every task.
"""

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# words are what stands between blanks: 0x20 and 0x09 to 0x0D
BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True

# words are runs of a-z, 0-9 and all non-ASCII characters
NO_LETTER = np.ones(256, bool)
NO_LETTER[48:58] = NO_LETTER[97:123] = NO_LETTER[128:] = False


def mix(x):
    """A bijection of 64-bit numbers that spreads every bit (finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, U64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _powers(n):
    """``base ** i`` and ``base ** -i`` for i < n, modulo 2**64."""
    if _POWERS.get("n", 0) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


def text_bytes(column):
    """``(bytes, offsets)`` of an Arrow string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(data):
    return LOWER[data]


def span_hashes(data, starts, ends, block=1 << 19):
    """64-bit hashes of ``data[start:end]``; spans are sorted and do not overlap."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        first = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, first + block, "right")))
        last = ends[stop - 1]
        up, down = _powers(last - first + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(last - first + 1, U64)
            np.cumsum((data[first:last].astype(U64) + U64(1)) * up[: last - first], out=sums[1:])
            s, e = starts[at:stop] - first, ends[at:stop] - first
            out[at:stop] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
        at = stop
    return out


def word_spans(data, offsets, separators=BLANK):
    """``(starts, ends, first)`` of all words; text i has words ``first[i]:first[i + 1]``."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separators[data]
    begins = inside[1:] & ~inside[:-1]
    closes = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    joint = cuts[inside[cuts] & inside[cuts + 1]]  # a word never crosses into the next text
    begins[joint] = True
    closes[joint] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data, offsets, separators=BLANK):
    """``(hashes, first, starts, ends)`` of the words of all texts."""
    starts, ends, first = word_spans(data, offsets, separators)
    return span_hashes(data, starts, ends), first, starts, ends


def shingle_hashes(words, first, width=5):
    """``(hashes, first)`` of all runs of ``width`` words in each text, repeats included.

    A text of fewer words, but not none, has one shingle: all its words.
    """
    counts = np.diff(first)
    short = (counts > 0) & (counts < width)
    n = np.where(counts >= width, counts - width + 1, short)
    edges = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(counts)), n)
    at = first[text] + (np.arange(edges[-1]) - edges[text])
    out = np.zeros(edges[-1], U64)
    last = first[text + 1]
    with np.errstate(over="ignore"):
        padded = np.concatenate([words, np.zeros(width, U64)])
        for i in range(width):
            value = np.where(at + i < last, padded[at + i], U64(0))
            out = mix(out * U64(_BASE) + value)
    return out, edges


def distinct(values, first):
    """Distinct values of each text, ascending: ``(values, first)``."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[new], text[new]
    return values, np.searchsorted(text, np.arange(len(first)))


def pieces(batches, rows=4096, size=2 << 20):
    """Arrow record batches cut so that a piece holds about ``size`` bytes of data or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(rows, int(batch.num_rows * size / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
