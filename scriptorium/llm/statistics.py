"""Numbers that describe a text: sizes, symbol shares, repetition, word and line shapes."""

import numpy as np

from scriptorium.llm.words import distinct, lowered, span_hashes, text_bytes, word_spans

NAMES = (
    "log_words", "log_lines", "word_length", "word_length_spread", "words_per_line",
    "upper", "digits", "marks", "symbols", "bars", "exclamations", "non_ascii", "blanks",
    "distinct_words", "distinct_pairs", "repeats", "entropy", "marked_words",
)

# byte classes
UPPER, DIGIT, MARK, SYMBOL, BAR, SHOUT, HIGH, SPACE = range(8)
CLASS = np.full(256, -1, np.int64)
CLASS[65:91] = UPPER
CLASS[48:58] = DIGIT
for _mark in b".,;:?'\"-()":
    CLASS[_mark] = MARK
for _symbol in b"#$%&*+/<=>@[\\]^_`{}~":
    CLASS[_symbol] = SYMBOL
CLASS[ord("|")] = BAR
CLASS[ord("!")] = SHOUT
CLASS[128:] = HIGH
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE


def _counts(text, n, weights=None):
    return np.bincount(text, weights, minlength=n)[:n].astype(np.float64)


def byte_histogram(data, offsets):
    """Counts of each byte per text."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(text * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)


def statistics(column):
    """One row of ``NAMES`` per text; an empty text has zeros."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    histogram = byte_histogram(data, offsets)
    size = np.maximum(histogram.sum(axis=1), 1)
    share = np.stack([histogram[:, CLASS == c].sum(axis=1) / size for c in range(8)], axis=1)
    p = histogram / size[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    low = lowered(data)
    starts, ends, first = word_spans(low, offsets)
    hashes = span_hashes(low, starts, ends)
    text = np.repeat(np.arange(n), np.diff(first))
    length = (ends - starts).astype(np.float64)
    words = np.diff(first).astype(np.float64)
    some = np.maximum(words, 1)
    mean = _counts(text, n, length) / some
    spread = np.sqrt(np.maximum(_counts(text, n, length**2) / some - mean**2, 0))
    lines = histogram[:, 10] + (words > 0)
    unique = np.diff(distinct(hashes, first)[1]) / some
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    with np.errstate(over="ignore"):
        pairs = hashes * np.uint64(3) + np.append(hashes[1:], np.zeros(min(1, len(hashes)), np.uint64))
    pairs = np.diff(distinct(pairs, first)[1]) / some
    last = CLASS[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    marked = _counts(text, n, np.isin(last, (SYMBOL, SHOUT, BAR))) / some
    return np.stack(
        [
            np.log1p(words), np.log1p(lines), mean, spread, words / np.maximum(lines, 1),
            share[:, UPPER], share[:, DIGIT], share[:, MARK], share[:, SYMBOL], share[:, BAR],
            share[:, SHOUT], share[:, HIGH], share[:, SPACE], unique, pairs,
            _counts(text, n, same) / some, entropy, marked,
        ],
        axis=1,
    )
