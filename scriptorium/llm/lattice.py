"""Sum over all segmentations of words into vocabulary pieces, many words at a time.

The pieces are a byte trie with two roots: pieces that begin a word and pieces inside one. A
word is one beginning piece, any number of inner pieces, and a stop, so the probabilities of
all words add up to one. The forward recursion runs over byte positions, for all words of a
block at once, in log space; the backward one gives the expected use of every piece.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BEGIN, INNER = 0, 1
SPACE = "▁"
# values of the forward table of one block of words
BLOCK = 1 << 20


@dataclass
class Lattice:
    """``edges``: sorted parent * 256 + byte, the child of edge i is node i + 2."""

    edges: np.ndarray
    begins: np.ndarray
    weights: np.ndarray
    alone: float
    stop: float

    def child(self, nodes, data):
        key = nodes * 256 + data
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, at + 2, -1)


def build(pieces):
    """Lattice from ``(piece, weight)``: bytes with a leading space mark for word beginnings."""
    mark = SPACE.encode()
    level, total, edges, begins = {BEGIN: [], INNER: []}, [0.0, 0.0], [], [True, False]
    for piece, weight in pieces:
        root = BEGIN if piece.startswith(mark) else INNER
        tail = piece.removeprefix(mark)
        if tail:
            level[root].append((tail, weight))
        else:
            total[root] += weight
    while level:
        following = {}
        keys = sorted({(parent, tail[0]) for parent, own in level.items() for tail, _ in own})
        number = {key: len(total) + i for i, key in enumerate(keys)}
        edges += [parent * 256 + byte for parent, byte in keys]
        begins += [begins[parent] for parent, _ in keys]
        total += [0.0] * len(keys)
        for parent, own in level.items():
            for tail, weight in own:
                child = number[parent, tail[0]]
                if len(tail) == 1:
                    total[child] += weight
                else:
                    following.setdefault(child, []).append((tail[1:], weight))
        level = following
    total, begins = np.array(total), np.array(begins)
    return normalised(np.array(edges, np.int64), begins, total, stop=0.3)


def normalised(edges, begins, uses, stop):
    """Log probabilities from how often each node's piece is used; node 0 is the bare mark."""
    first, inner = uses[begins].sum(), uses[~begins].sum()
    with np.errstate(divide="ignore"):
        weights = np.where(
            begins, np.log(uses / first), np.log(uses / max(inner, 1e-300) * (1 - stop))
        )
    alone = weights[BEGIN]
    return Lattice(edges, begins, weights, alone, np.log(stop))


def _arcs(lattice, table, sizes, root, at):
    """``(words, nodes, length)`` of all pieces that match at byte ``at``."""
    rows = np.flatnonzero(sizes > at)
    nodes = np.full(len(rows), root, np.int64)
    length = 0
    while len(rows):
        nodes = lattice.child(nodes, table[rows, at + length])
        length += 1
        going = nodes >= 0
        rows, nodes = rows[going], nodes[going]
        whole = np.isfinite(lattice.weights[nodes])
        if whole.any():
            yield rows[whole], nodes[whole], length
        longer = sizes[rows] > at + length
        rows, nodes = rows[longer], nodes[longer]


def _padded(words):
    sizes = np.array([len(w) for w in words])
    table = np.zeros((len(words), max(1, sizes.max(initial=0))), np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), sizes)
    table[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return table, sizes


def _forward(lattice, words, keep=False):
    table, sizes = _padded(words)
    n = len(words)
    alpha = np.full((n, table.shape[1] + 1), -np.inf)
    alpha[:, 0] = lattice.alone
    arcs = []
    for at in range(table.shape[1]):
        for root in (BEGIN, INNER) if at == 0 else (INNER,):
            for rows, nodes, length in _arcs(lattice, table, sizes, root, at):
                source = 0.0 if root == BEGIN else alpha[rows, at]
                value = source + lattice.weights[nodes]
                alpha[rows, at + length] = np.logaddexp(alpha[rows, at + length], value)
                if keep:
                    arcs.append((root, at, rows, nodes, length))
    return alpha, alpha[np.arange(n), sizes] + lattice.stop, sizes, arcs


def _blocks(words):
    """Positions of words of like length, in blocks of about ``BLOCK`` table values."""
    order = np.argsort([len(w) for w in words], kind="stable")
    at = 0
    while at < len(order):
        stop, longest = at + 1, len(words[order[at]])
        while stop < len(order):
            longest = len(words[order[stop]])
            if (stop - at + 1) * (longest + 1) > BLOCK or longest > 2 * len(words[order[at]]) + 8:
                break
            stop += 1
        yield order[at:stop]
        at = stop


def log_probabilities(lattice, words):
    """Natural log of each word's probability over all its segmentations."""
    out = np.empty(len(words))
    for block in _blocks(words):
        out[block] = _forward(lattice, [words[i] for i in block])[1]
    return out


def expected_uses(lattice, words, counts):
    """``(uses of each node, stops)`` summed over the words with their counts."""
    uses = np.zeros(len(lattice.weights))
    for block in _blocks(words):
        weight = counts[block]
        alpha, whole, sizes, arcs = _forward(lattice, [words[i] for i in block], keep=True)
        beta = np.full(alpha.shape, -np.inf)
        beta[np.arange(len(block)), sizes] = lattice.stop
        sound = np.isfinite(whole)
        for root, at, rows, nodes, length in reversed(arcs):
            value = beta[rows, at + length] + lattice.weights[nodes]
            source = 0.0 if root == BEGIN else alpha[rows, at]
            ok = sound[rows] & np.isfinite(value)
            share = np.exp(source + value - whole[rows], where=ok, out=np.zeros(len(rows)))
            uses += np.bincount(nodes, share * weight[rows], len(uses))
            if root == INNER:
                beta[rows, at] = np.logaddexp(beta[rows, at], value)
        bare = lattice.alone + beta[:, 0] - whole
        uses[BEGIN] += (np.exp(bare, where=sound & np.isfinite(bare), out=np.zeros(len(block))) * weight).sum()
    return uses, float(counts.sum())


def vocabulary(path):
    """``(piece bytes, weight)`` of a vocabulary file.

    Scores of a unigram vocabulary are log probabilities. Those of a merge vocabulary are
    negated ranks, from which Zipf's law gives the weights.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    scores = [model.get_score(i) for i in ids]
    ranked = all(s == int(s) for s in scores)
    for i, score in zip(ids, scores):
        piece = model.id_to_piece(i)
        raw = bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.encode()
        yield raw, 1 / (2.7 - score) if ranked else float(np.exp(score))


def words_of(column):
    """Python bytes of an Arrow string or binary column."""
    return column.cast(pa.binary()).to_pylist()
