"""Token counts that follow edits: a segment tree per document, re-encoded only where touched.

A document's text is cut into leaves of about ``LEAF`` characters where no pre-token can cross:
before a single blank between two letters or digits. The tree keeps the characters and the tokens
of every subtree. An edit descends to the leaves it touches, encodes those again and adds the
difference on the way up. If the new text makes a leaf's border unsafe, the next leaf is joined
to it first (its old place stays, empty); so every leaf is again encoded as in the whole text,
and the total equals that of encoding the edited text anew.

Edits of a document are applied in order; their places refer to the text at that time. All
passes are narrow: nothing is exchanged unless edits come from a table of their own.

Edge cases: null text is empty; a null edit list is none; places beyond the text are moved to its end;
an end before the start means an insertion; a null replacement deletes; edits of equal ``seq``
stand in order of place and text; a document with edits but without row is ignored; rows of one
doc_id each get the edits of that id. An empty table gives an empty one.
"""

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scriptorium.llm.tables import load
from scriptorium.llm.words import pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pre-token pattern that belongs to the vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 512
EDIT = "struct<start:int,end:int,text:string>"

# personal data and secrets: mail addresses, IPv4 and card numbers, phones, keys, passwords
PRIVATE = (
    r"(?<![\w.%+-])[\w.%+-]++@[\w-]++(?:\.[\w-]++)+"
    r"|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.]*\d)"
    r"|(?<!\w)\d{13,16}(?!\w)"
    r"|\+\d{1,3} \(\d{3}\) \d{3}-\d{4}"
    r"|(?<!\w)AKIA[0-9A-Z]{16}(?!\w)"
    r"|(?<!\w)password=\S++"
)
MASK = "[private]"


def encoder(content):
    """``text -> number of tokens`` from the bytes of a rank file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x)}
    encoding = tiktoken.Encoding(
        "ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return lambda text: len(encoding.encode_ordinary(text))


def safe(text, at):
    """No pre-token of ``text`` crosses ``at``, whatever stands further left or right."""
    return at > 0 and border(text[at - 1 : at + 2])


def border(around):
    """``safe`` for the three characters around a place; fewer stand at an end of the text."""
    return len(around) == 3 and around[1] == " " and around[0].isalnum() and around[2].isalnum()


def cut(text, leaf=LEAF):
    """Lengths of the leaves of a text."""
    lengths, start = [], 0
    while len(text) - start > leaf:
        at = text.find(" ", start + leaf)
        while at != -1 and not safe(text, at):
            at = text.find(" ", at + 1)
        if at == -1:
            break
        lengths.append(at - start)
        start = at
    return [*lengths, len(text) - start]


class Tree:
    """Segment tree over leaves; node i has children 2i and 2i + 1, node 1 is the root."""

    def __init__(self, text, chars, tokens, count):
        self.width = 1 << max(0, len(chars) - 1).bit_length()
        ends = np.cumsum(chars).tolist()
        # each leaf keeps its own piece of the text, so an edit copies no more than it touches
        self.own = [text[e - n : e] for n, e in zip(chars, ends)]
        self.own += [""] * (self.width - len(self.own))
        self.count, self.encoded = count, 0
        self.chars, self.tokens = self._sums(chars), self._sums(tokens)

    def _sums(self, leaves):
        node = [0] * self.width + list(leaves) + [0] * (self.width - len(leaves))
        for i in range(self.width - 1, 0, -1):
            node[i] = node[2 * i] + node[2 * i + 1]
        return node

    @property
    def text(self):
        return "".join(self.own)

    def leaves(self):
        return self.chars[self.width :], self.tokens[self.width :]

    def find(self, at):
        """``(leaf, its start)`` of the leaf that holds character ``at``, or the last used one."""
        at = min(at, max(self.chars[1] - 1, 0))
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def _set(self, leaf, chars, tokens):
        node = leaf + self.width
        add_chars, add_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node and (add_chars or add_tokens):
            self.chars[node] += add_chars
            self.tokens[node] += add_tokens
            node //= 2

    def peek(self, at, n):
        """Up to ``n`` characters from ``at`` on."""
        out = ""
        while len(out) < n and 0 <= at + len(out) < self.chars[1]:
            leaf, begin = self.find(at + len(out))
            skip = at + len(out) - begin
            out += self.own[leaf][skip : skip + n - len(out)]
        return out

    def edit(self, start, end, replacement):
        whole = self.chars[1]
        start = min(max(start, 0), whole)
        end = min(max(end, start), whole)
        first, begin = self.find(start)
        last, last_begin = self.find(max(end - 1, start))
        stop = last_begin + self.chars[last + self.width]
        old = "".join(self.own[first : last + 1])
        text = old[: start - begin] + replacement + old[end - begin :]
        # boundary context: a border that is no longer safe takes the neighbour in
        while begin > 0 and not border(self.peek(begin - 1, 1) + (text[:2] + self.peek(stop, 2))[:2]):
            first, begin = self.find(begin - 1)
            text = self.own[first] + text
        while stop < whole and not border((text or self.peek(begin - 1, 1))[-1:] + self.peek(stop, 2)):
            last, at = self.find(stop)
            text += self.own[last]
            stop = at + self.chars[last + self.width]
        for leaf in range(first + 1, last + 1):
            if self.chars[leaf + self.width]:
                self.own[leaf] = ""
                self._set(leaf, 0, 0)
        self.own[first] = text
        self.encoded += len(text)
        self._set(first, len(text), self.count(text))


TREES = f"doc_id long, text string, edits array<{EDIT}>, chars array<int>, tokens array<int>"
COUNTS = (
    f"doc_id long, text string, chars array<int>, tokens array<int>, "
    "n_edits long, n_tokens_before long, n_tokens long, n_encoded_again long"
)


def _build(content, leaf):
    def run(batches):
        count = encoder(content)
        ints = pa.list_(pa.int32())
        for batch in pieces(batches):
            chars, tokens = [], []
            for text in batch["text"].to_pylist():
                text = text or ""
                lengths = cut(text, leaf)
                ends = np.cumsum(lengths).tolist()
                chars.append(lengths)
                tokens.append([count(text[e - n : e]) for n, e in zip(lengths, ends)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(chars, ints), pa.array(tokens, ints)],
                [*batch.schema.names, "chars", "tokens"],
            )

    return run


def _apply(content):
    def run(batches):
        count = encoder(content)
        ints = pa.list_(pa.int32())
        for batch in pieces(batches):
            columns = [batch[n].to_pylist() for n in ("text", "edits", "chars", "tokens")]
            out = [[] for _ in range(7)]
            for text, edits, chars, tokens in zip(*columns):
                before, encoded = sum(tokens), 0
                text = text or ""
                if edits:
                    tree = Tree(text, chars, tokens, count)
                    for e in edits:
                        tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                    text, encoded = tree.text, tree.encoded
                    chars, tokens = tree.leaves()
                row = (text, chars, tokens, len(edits or ()), before, sum(tokens), encoded)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.string(), ints, ints, pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = COUNTS.replace(" array<int>", "").replace(" string", "").replace(" long", "")
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, k) for c, k in zip(out, kinds))],
                names.split(", "),
            )

    return run


def _content(path):
    with open(path, "rb") as file:
        return file.read()


def build_trees(rows, vocabulary=VOCABULARY, leaf=LEAF):
    """Leaf lengths and tokens for ``rows(doc_id, text, edits)``: what a tree is made of."""
    return rows.mapInArrow(_build(_content(vocabulary), leaf), TREES)


def count_edited(trees, vocabulary=VOCABULARY):
    """Texts, trees and counts after each row's ``edits``, encoding only what they touch."""
    return trees.mapInArrow(_apply(_content(vocabulary)), COUNTS)


def with_edits(docs, edits):
    """``docs`` with their rows of ``edits(doc_id, seq, start, end, text)`` as an array."""
    row = F.struct("seq", "start", "end", "text")
    lists = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(row)),
            lambda x: F.struct(
                x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"),
                x["text"].cast("string").alias("text"),
            ),
        ).alias("edits")
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.join(lists, "doc_id", "left")


def private_edits(text):
    """Edits that mask personal data and secrets, from left to right; null where there are none."""
    return F.arrow_udf(_masks, f"array<{EDIT}>")(text)


def _masks(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
    private = re.compile(PRIVATE, re.ASCII)
    rows = []
    for value in text.to_pylist():
        edits, shift = [], 0
        for hit in private.finditer(value or ""):
            edits.append({"start": hit.start() + shift, "end": hit.end() + shift, "text": MASK})
            shift += len(MASK) - (hit.end() - hit.start())
        rows.append(edits or None)
    return pa.array(rows, kind)


def op3_token_counts(spark, sf_dir):
    """Tokens of every document before and after masking personal data and secrets."""
    docs = load(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long"), F.col("text").cast("string")
    )
    rows = docs.select("doc_id", "text", private_edits(F.col("text")).alias("edits"))
    return count_edited(build_trees(rows)).select(
        "doc_id", "n_edits", "n_tokens_before", "n_tokens", "n_encoded_again",
        F.size(F.filter("chars", lambda n: n > 0)).cast("long").alias("n_leaves"),
    )
