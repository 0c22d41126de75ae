"""Preparing and judging training records: checks, class balance, splits, overlap scores."""

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from scriptorium.functions.text import strip_text, words
from scriptorium.operators.ordinals import with_ordinal
from scriptorium.operators.skew import look_up

# task functions travel with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROLES = ("system", "user", "assistant")
# Share of records per split, in tenths.
SPLITS = (("train", 8), ("validation", 1), ("test", 1))
HEX = "0123456789abcdef"


def _hash_number(column, digits):
    """The first hex digits of the MD5 of a value as a number; the same on every engine."""
    code = F.md5(column.cast("string").cast("binary"))
    return F.conv(F.substring(code, 1, digits), 16, 10).cast("long")


def _record_code(role, text):
    """Hash of role and text; the length of the role tells where it ends."""
    size = F.coalesce(F.length(role), F.lit(-1)).cast("string")
    return F.sha2(F.concat_ws(":", size, F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))), 256)


def validate_records(records, keys, known_roles=ROLES):
    """Add ``valid`` and ``reason`` to ``records(*keys, role, text)``.

    A record without text (nothing but white space of any kind), of an unknown role, or equal to an
    earlier one in role and text is not valid. Equal records meet as hashes of their texts; first is
    the one with the least keys, and of rows with equal keys one. Rows equal in all columns are
    counted before they meet, however many they are.
    """
    columns = records.columns
    coded = records.withColumn("_code", _record_code(F.col("role"), F.col("text")))
    counted = coded.groupBy(*columns, "_code").agg(F.count("*").alias("_n")).withColumn(
        "_place", F.struct(*keys, F.xxhash64(*columns).alias("_row"))
    )
    first = counted.groupBy("_code").agg(F.min("_place").alias("_first"))
    met = look_up(counted, first, ["_code"], keys[-1])
    numbered = met.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    reason = (
        F.when(F.coalesce(strip_text(F.col("text")), F.lit("")) == "", "no_text")
        .when(~F.coalesce(F.col("role").isin(*known_roles), F.lit(False)), "unknown_role")
        .when(~F.col("_place").eqNullSafe(F.col("_first")) | (F.col("_copy") > 1), "duplicate")
        .otherwise("")
    )
    return numbered.select(*columns, reason.alias("reason"), (reason == "").alias("valid"))


def label_balance(records, label):
    """Per class: rows, share of all, and rows for each of the smallest class."""
    counts = records.groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.select(F.sum("n").alias("total"), F.min("n").alias("least"))
    total, least = (whole.select(c).scalar() for c in ("total", "least"))
    return counts.select(
        label, "n", F.round(F.col("n") / total, 6).alias("share"),
        F.round(F.col("n") / least, 6).alias("ratio"),
    )


def balanced(records, key, label):
    """As many rows of every class as the smallest has, chosen by a hash of ``key``.

    Rows are numbered within their class in blocks, so no task sorts a whole class.
    """
    counts = records.groupBy(label).agg(F.count("*").alias("n"))
    least = counts.select(F.min("n")).scalar()
    drawn = records.withColumn("_draw", _hash_number(F.col(key), 15))
    numbered = with_ordinal(drawn, [label], "_draw", "_no")
    return numbered.where(F.col("_no") < least).select(*records.columns)


def split_80_10_10(records, key):
    """Add ``split``; all rows of one key are in the same one, in every run."""
    place, until, split = F.pmod(_hash_number(F.col(key), 8), F.lit(10)), 0, None
    for name, tenths in SPLITS:
        until += tenths
        split = F.when(place < until, name) if split is None else split.when(place < until, name)
    return records.withColumn("split", split)


def _ngrams(words, n):
    """All n-grams of a column of words."""
    if n == 1:
        return words
    grams = F.transform(
        F.sequence(F.lit(0), F.size(words) - n),
        lambda i: F.array_join(F.slice(words, i + 1, n), " "),
    )
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def rouge_scores(pairs, keys, n=1):
    """Overlap of n-grams of ``candidate`` with those of ``reference``, for each keyed pair.

    ``(*keys, n_candidate, n_reference, n_common, f1)``; repeats count as often as both have
    them. Texts are split into words once; grams are counted by pair and gram before anything is
    exchanged.
    """
    sides = []
    for name, is_candidate in (("candidate", 1), ("reference", 0)):
        split = pairs.select(*keys, words(F.coalesce(name, F.lit(""))).alias("_words"))
        grams = F.explode(_ngrams(F.col("_words"), n)).alias("gram")
        one, other = (F.lit(v).cast("long") for v in (is_candidate, 1 - is_candidate))
        sides.append(split.select(*keys, grams, one.alias("c"), other.alias("r")))
    by_gram = sides[0].unionByName(sides[1]).groupBy(*keys, "gram").agg(
        F.sum("c").alias("c"), F.sum("r").alias("r")
    )
    totals = by_gram.groupBy(*keys).agg(
        F.sum("c").alias("n_candidate"), F.sum("r").alias("n_reference"),
        F.sum(F.least("c", "r")).alias("n_common"),
    )
    listed = pairs.select(*keys).join(totals, keys, "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_candidate", "n_reference", "n_common")]
    return listed.select(*keys, *counts).withColumn("f1", _f1())


def _f1():
    size = F.col("n_candidate") + F.col("n_reference")
    return F.when(size > 0, F.round(2 * F.col("n_common") / size, 6)).otherwise(0.0)


def longest_common(one, other):
    """Length of the longest common subsequence, in space linear in the lengths.

    A bit per word of ``one`` tells whether the row of the table of prefixes rises there; a word of
    ``other`` turns a whole row into the next by one addition of long integers.
    """
    places = {}
    for i, word in enumerate(one):
        places.setdefault(word, []).append(i)
    size = (len(one) + 8) // 8
    masks = {}
    for word in set(other) & places.keys():
        bits = bytearray(size)
        for i in places[word]:
            bits[i >> 3] |= 1 << (i & 7)
        masks[word] = int.from_bytes(bits, "little")
    whole = (1 << len(one)) - 1
    row = whole
    for mask in filter(None, map(masks.get, other)):
        hit = row & mask
        row = ((row + hit) | (row - hit)) & whole
    return len(one) - row.bit_count()


def _common_lengths(keys):
    def run(batches):
        for batch in batches:
            pairs = zip(batch["candidate"].to_pylist(), batch["reference"].to_pylist())
            counts = [(len(c), len(r), longest_common(c, r)) for c, r in pairs]
            columns = [pa.array([x[i] for x in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *columns], [
                *keys, "n_candidate", "n_reference", "n_common",
            ])

    return run


def rouge_l_scores(pairs, keys):
    """As ``rouge_scores``, by the longest common subsequence of words instead of n-grams.

    A row of its own for each row of ``pairs``; nothing is exchanged.
    """
    sides = [words(F.coalesce(name, F.lit(""))).alias(name) for name in ("candidate", "reference")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema)
    split = pairs.select(*keys, *sides)
    return split.mapInArrow(
        _common_lengths(keys), f"{kinds}, n_candidate long, n_reference long, n_common long"
    ).withColumn("f1", _f1())


def answer_pairs(turns):
    """Consecutive turns of one conversation: a user's text and the assistant's answer to it."""
    asked = turns.where("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference")
    )
    answered = turns.where("role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("candidate")
    )
    return answered.join(asked, ["conv_id", "turn"])
