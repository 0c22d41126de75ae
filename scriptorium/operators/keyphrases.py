"""Statistical key phrases of one to three words, from one document alone.

Every word of a document gets a score from how it stands in it, smaller for more telling words:

* casing: how often it is written with a capital within a sentence, or all in capitals;
* position: the median number of the sentences that have it;
* frequency, against the mean and deviation of the document's words;
* context: how many different words stand left and right of it, against how many stand there at all;
* spread: the share of sentences that have it.

A phrase is a run of words of one sentence whose first and last are no short words. Its score is
the product of its words' scores over its count and their sum, so frequent phrases of telling words
come first. Of phrases that are equal up to a small edit distance the better one stays.

A document is one row and needs no other, so texts are exchanged once, to deal them evenly, and
phrases never become rows unless they are asked for. Python takes some thousand texts at a time as
arrays of word numbers: words of a document, then pairs, then longer runs are told apart by sorting
numbers. What is a letter and what ends a sentence is left to SQL.
"""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from scriptorium.session import parts_of

SENTENCE = r"[.!?]"  # a line ends one too
OTHER = r"[^\p{L}\n]+"
BLANK, NEWLINE = b" \n"
SHORT = 3  # shorter words neither begin nor end a phrase
LONGEST = 3
ALIKE = 0.8  # share of letters that near-equal phrases have in common at least
DIGITS = 6
SLICE_BYTES = 3 << 19  # text taken at a time, a few hundred thousand words; a larger text comes alone
FEW = 4  # candidates first looked at for each phrase wanted


def _words(docs):
    """``(doc_id, text)``: words with single blanks between, sentences with newlines."""
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    placed = texts.repartition(parts_of(docs), "doc_id")
    text = F.regexp_replace(F.regexp_replace("text", SENTENCE, "\n"), OTHER, " ")
    return placed.select("doc_id", text.alias("text"))


def _slices(batches, size):
    """Batches of about ``size`` bytes of text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            past = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            past = max(past, at + 1)
            yield batch.slice(at, past - at)
            at = past


def _groups(keys):
    """``(order, first)``: rows in order of ``keys``, equal ones in order; where in it each key begins."""
    n = len(keys)
    bits = n.bit_length()
    if n and int(keys.max()) < 1 << (63 - bits):
        # numbers sort several times faster alone than with the places they come from
        order = np.sort((keys << bits) | np.arange(n))
        keys, order = order >> bits, order & ((1 << bits) - 1)
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    return order, np.flatnonzero(np.diff(keys, prepend=-1))


def _rounded(x):
    """As SQL rounds: halves of the decimal that is written go up."""
    unit = 10.0**DIGITS
    y = x * unit
    whole = np.floor(y)
    found = np.where(x < 2.0**52, np.floor(y + 0.5) / unit, x)
    for i in np.flatnonzero((np.abs(y - whole - 0.5) <= 1e-9 + 1e-15 * y) & (x < 2.0**52)):
        found[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP))
    return found


def _listed(strings):
    """As ``to_pylist``, which makes an Arrow object of each on the way."""
    return strings.to_numpy(zero_copy_only=False).tolist()


class _Texts:
    """Words of some texts, one after the other, and the scores of their phrases.

    ``row`` has the rows of texts with words; ``word`` the number of each place's word among its text's.
    """

    def __init__(self, texts):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, edges, data = texts.buffers()
        edges = np.frombuffer(edges, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        letter = data > BLANK
        before, after = np.roll(letter, 1), np.roll(letter, -1)
        filled = edges[:-1] < edges[1:]
        before[edges[:-1][filled]] = after[edges[1:][filled] - 1] = False
        begin = np.flatnonzero(letter & ~before)
        sizes = np.flatnonzero(letter & ~after) + 1 - begin
        self.n = len(begin)

        text = np.searchsorted(edges, begin, "right") - 1
        line = np.searchsorted(np.flatnonzero(data == NEWLINE), begin)
        turned = np.diff(text, prepend=-1) != 0
        self.row, self.text = text[turned], np.cumsum(turned) - 1
        self.starts = turned | (np.diff(line, prepend=-1) != 0)
        self.sentence = np.cumsum(self.starts) - 1
        self._number(pa.LargeStringArray.from_buffers(
            self.n, pa.py_buffer(np.append(0, np.cumsum(sizes))), pa.py_buffer(data[letter])
        ))

    def _number(self, shown):
        """Numbers of the words in lower case, and which are written with capitals."""
        shown = shown.dictionary_encode()
        ways, at = _listed(shown.dictionary), shown.indices.to_numpy(zero_copy_only=False)
        # all at once; a line break ends a word for the rule of the final sigma too
        low = "\n".join(ways).lower().split("\n")
        capital, acronym = np.zeros(len(ways), bool), np.zeros(len(ways), bool)
        for i in [i for i, (way, term) in enumerate(zip(ways, low)) if way != term]:
            capital[i] = ways[i][0] != ways[i][0].lower()
            acronym[i] = len(ways[i]) > 1 and ways[i] == ways[i].upper()
        low = pa.array(low, pa.large_string()).dictionary_encode()
        self.terms = _listed(low.dictionary)
        self.term = low.indices.to_numpy(zero_copy_only=False).astype(np.int64)[at]
        self.capital, self.acronym = capital[at] & ~self.starts, acronym[at]

    def runs(self, longest):
        """``(first, n)`` for one word, two and so on: where each run of a text stands first, how often.

        Sets ``word`` and ``score`` on the way, which need the runs of two words.
        """
        order, first = _groups(self.text * len(self.terms) + self.term)
        tf = np.diff(first, append=self.n)
        self.word = np.empty(self.n, np.int64)
        self.word[order] = np.repeat(np.arange(len(tf)), tf)
        found = [(order[first], tf)]
        # ``run[i]`` is the number of the run at place ``at[i]``
        at, run = np.arange(self.n), self.word
        goes_on = np.append(~self.starts[1:], False)
        for n in range(1, max(longest, 2)):
            more = goes_on[at + n - 1]
            at = at[more]
            kinds, begins = _groups(run[more] * len(tf) + self.word[at + n])
            counts = np.diff(begins, append=len(at))
            found.append((at[kinds[begins]], counts))
            run = np.empty(len(at), np.int64)
            run[kinds] = np.repeat(np.arange(len(counts)), counts)
        self.score = self._scores(order, first, tf, found[1][0], goes_on)
        return found[:longest]

    def _scores(self, order, first, tf, pairs, goes_on):
        def count(words):
            return np.bincount(words, minlength=len(tf))

        def variety(kinds, places):
            return count(kinds) / np.maximum(count(places), 1)

        text = self.text[order[first]]
        begin = np.flatnonzero(np.diff(text, prepend=-1))
        terms = np.diff(begin, append=len(tf))
        mean = np.add.reduceat(tf, begin) / terms
        deviation = np.sqrt(np.add.reduceat((tf - mean[text]) ** 2, begin) / terms)
        most = np.maximum.reduceat(tf, begin)[text]
        opening = self.sentence[np.flatnonzero(np.diff(self.text, prepend=-1))]
        sentences = np.diff(opening, append=self.sentence[-1] + 1)[text]

        own = self.sentence[order]
        new = np.diff(own, prepend=-1) != 0
        new[first] = True
        place = (own[first + (tf - 1) // 2] + own[first + tf // 2]) / 2 - opening[text]
        cased = np.maximum(count(self.word[self.capital]), count(self.word[self.acronym]))

        casing = cased / (1 + np.log(tf))
        position = np.log(np.log(3 + place)) + 1
        frequency = tf / (mean + deviation)[text]
        beside = variety(self.word[pairs + 1], self.word[~self.starts]) + variety(self.word[pairs], self.word[goes_on])
        context = 1 + beside * tf / most
        share = np.add.reduceat(new, first, dtype=np.int64) / sentences
        return context * position / (casing + frequency / context + share / context)

    def phrases(self, longest, short):
        """``(words, first, n, score)`` by the number of words; each in order of the texts."""
        enough = np.array([len(t) >= short for t in self.terms])[self.term]
        for words, (first, n) in enumerate(self.runs(longest), 1):
            kept = enough[first] & enough[first + words - 1]
            first, n = first[kept], n[kept]
            scores = np.sort([self.score[self.word[first + i]] for i in range(words)], axis=0)
            product, total = np.ones(len(first)), np.zeros(len(first))
            for s in scores:
                product, total = product * s, total + s
            yield words, first, n, _rounded(product / (n * (1 + total)))

    def phrase(self, words, first):
        return " ".join([self.terms[t] for t in self.term[first : first + words].tolist()])


def _scored(longest, short):
    def run(batches):
        for batch in _slices(batches, SLICE_BYTES):
            texts = _Texts(batch["text"])
            if not texts.n:
                continue
            for words, first, n, score in texts.phrases(longest, short):
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].take(pa.array(texts.row[texts.text[first]])),
                    pa.array([texts.phrase(words, i) for i in first.tolist()], pa.string()),
                    pa.array(n, pa.int64()), pa.array(score, pa.float64()),
                ], ["doc_id", "phrase", "n", "score"])

    return run


def scored_phrases(docs, longest=LONGEST, short=SHORT):
    """``(doc_id, phrase, n, score)`` of all phrases, the best with the smallest score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _words(docs).mapInArrow(_scored(longest, short), f"doc_id {kind}, phrase string, n long, score double")


def distance(one, other):
    """Edits that make one text of the other, a row of the table at a time as the bits of a number."""
    places = {}
    for i, c in enumerate(one):
        places[c] = places.get(c, 0) | 1 << i
    whole, end = (1 << len(one)) - 1, 1 << len(one) >> 1
    up, down, edits = whole, 0, len(one)
    for c in other:
        same = places.get(c, 0)
        level = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | (whole & ~(across | up)), up & across
        edits += bool(more & end) - bool(less & end)
        more, less = (more << 1 | 1) & whole, (less << 1) & whole
        up, down = less | (whole & ~(level | more)), more & level
    return edits if one else len(other)


def _letters(phrase):
    """A bit for each letter, several of them sharing one."""
    return sum({1 << (ord(c) & 63) for c in phrase})


def _similar(one, ones, other, others, alike):
    most = max(len(one), len(other)) * (1 - alike) + 1e-9
    # every letter that only one of them has takes an edit
    least = max(abs(len(one) - len(other)), (ones & ~others).bit_count(), (others & ~ones).bit_count())
    return least <= most and distance(one, other) <= most


def _best_of(score, phrase, k, alike):
    """``(score, phrase)`` of the ``k`` best of one text; ``phrase(i)`` writes the phrase of ``score[i]``.

    Looks at some of the smallest scores, and at more while these don't give ``k`` phrases.
    """
    size = FEW * k
    while True:
        every = len(score) <= size
        near = np.arange(len(score)) if every else np.flatnonzero(score <= np.partition(score, size)[size])
        taken = []
        for s, p in sorted(zip(score[near].tolist(), map(phrase, near.tolist()))):
            if len(taken) == k:
                break
            letters = _letters(p)
            if not any(_similar(t, ts, p, letters, alike) for _, t, ts in taken):
                taken.append((s, p, letters))
        if every or len(taken) == k:
            return [(s, p) for s, p, _ in taken]
        size *= 4


def _best(k, longest, short, alike):
    def run(batches):
        for batch in _slices(batches, SLICE_BYTES):
            texts = _Texts(batch["text"])
            if not texts.n:
                continue
            kinds = list(texts.phrases(longest, short))
            cuts = [np.searchsorted(texts.text[first], np.arange(len(texts.row) + 1)) for _, first, _, _ in kinds]
            rows, ranks, phrases, scores = [], [], [], []
            for i, row in enumerate(texts.row.tolist()):
                own = [(words, first[c[i] : c[i + 1]], score[c[i] : c[i + 1]])
                       for (words, first, _, score), c in zip(kinds, cuts)]
                first = np.concatenate([f for _, f, _ in own])
                words = np.repeat([w for w, _, _ in own], [len(f) for _, f, _ in own])
                found = _best_of(
                    np.concatenate([s for *_, s in own]), lambda j: texts.phrase(words[j], first[j]), k, alike
                )
                rows += [row] * len(found)
                ranks += range(1, len(found) + 1)
                scores += [s for s, _ in found]
                phrases += [p for _, p in found]
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(ranks, pa.int64()),
                pa.array(phrases, pa.string()), pa.array(scores, pa.float64()),
            ], ["doc_id", "rank", "phrase", "score"])

    return run


def key_phrases(docs, k=5, longest=LONGEST, short=SHORT, alike=ALIKE):
    """``(doc_id, rank, phrase, score)``: the ``k`` best phrases of each document, ties by phrase.

    A phrase like a better one already taken is passed over. ``docs(doc_id, text)`` has one row
    per document; null and empty texts have none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _words(docs).mapInArrow(
        _best(k, longest, short, alike), f"doc_id {kind}, rank long, phrase string, score double"
    )
