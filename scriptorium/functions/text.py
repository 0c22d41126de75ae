"""Text helpers, Column to Column, built from JVM expressions only."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that a strip removes at the ends: Unicode white space plus U+001C to U+001F.
OUTER_BLANKS = "".join(filter(str.isspace, map(chr, range(0x3001))))


def require_needle(find_text):
    if not find_text:
        raise ValueError("find_text must not be empty")


def strip_text(text):
    return F.btrim(text, F.lit(OUTER_BLANKS))


def as_column(value):
    return value if isinstance(value, Column) else F.lit(value)


def quoted_pattern(needle):
    """Regular expression that matches ``needle`` literally."""
    inner = F.replace(as_column(needle), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), inner, F.lit("\\E"))


def quoted_replacement(value):
    """``value`` with the two characters special in a replacement made literal."""
    escaped = F.replace(as_column(value), F.lit("\\"), F.lit("\\\\"))
    return F.replace(escaped, F.lit("$"), F.lit("\\$"))


# Letters whose other case a JVM with the Unicode tables of 2020 does not fold, each
# with its partner at the same place below.
UNFOLDED = (
    "\u00df\u0390\u03b0\u2c2f\ua7c0\ua7d0\ua7d6\ua7d8\ufb05"
    + "".join(map(chr, (c for c in range(0x10570, 0x10596) if c not in (0x1057B, 0x1058B, 0x10593))))
)
PARTNERS = (
    "\u1e9e\u1fd3\u1fe3\u2c5f\ua7c1\ua7d1\ua7d7\ua7d9\ufb06"
    + "".join(chr(ord(c) + 0x27) for c in UNFOLDED[9:])
)


def _caseless(needle):
    """Pattern of a caseless search; letters that the JVM does not fold match their partner too."""
    quoted = quoted_pattern(needle)
    partner = lambda c: F.translate(c, UNFOLDED + PARTNERS, PARTNERS + UNFOLDED)
    either = F.transform(
        F.split(quoted, ""),
        lambda c: F.when(partner(c) == c, c).otherwise(F.concat(F.lit("\\E["), c, partner(c), F.lit("]\\Q"))),
    )
    spliced = F.when(partner(quoted) == quoted, quoted).otherwise(F.array_join(either, ""))
    return F.concat(F.lit("(?iu)"), spliced)


def count_exact(text, find_text):
    """Non-overlapping occurrences, from the length lost when they are removed."""
    needle = as_column(find_text)
    lost = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (lost / F.length(needle)).cast("long")).otherwise(
        F.lit(0).cast("long")
    )


def replace_exact(text, find_text, replace_text):
    return F.replace(text, as_column(find_text), as_column(replace_text))


def count_caseless(text, find_text):
    needle = as_column(find_text)
    hits = F.regexp_count(text, _caseless(needle)).cast("long")
    return F.when(F.length(needle) > 0, hits).otherwise(F.lit(0).cast("long"))


def replace_caseless(text, find_text, replace_text):
    needle = as_column(find_text)
    replaced = F.regexp_replace(text, _caseless(needle), quoted_replacement(replace_text))
    return F.when(F.length(needle) > 0, replaced).otherwise(text)


def count_matches(text, find_text, case_sensitive=True):
    return (count_exact if case_sensitive else count_caseless)(text, find_text)


def replace_matches(text, find_text, replace_text, case_sensitive=True):
    return (replace_exact if case_sensitive else replace_caseless)(text, find_text, replace_text)


def page_search_pattern(find_text, gap="\\s+"):
    """Pattern of a page search: ASCII case ignored, a blank run matches any ``gap``."""
    words = F.split(as_column(find_text), r"\s+")
    return F.concat(F.lit("(?i)"), F.array_join(F.transform(words, quoted_pattern), gap))


# Characters of our own within a page's joined text: the end of a block, an escape, a hit. Where a
# text has them itself they are escaped.
BLOCK_END, ESCAPE, HIT = "\ue000", "\ue001", "\ue004"
ESCAPED = ((ESCAPE, ESCAPE + "\ue003"), (BLOCK_END, ESCAPE + "\ue002"), (HIT, ESCAPE + "\ue005"))
# between two words of a page: the end of a block, kept as a group, or blanks
PAGE_GAP = rf"(?:\s*({BLOCK_END})\s*|\s+)"


def escaped(text):
    for plain, safe in ESCAPED:
        text = F.replace(as_column(text), F.lit(plain), F.lit(safe))
    return text


def unescaped(text):
    for plain, safe in reversed(ESCAPED):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def mark_page_hits(page, find_text, replace_text):
    """``page`` with a mark and the replacement for each hit; ends of blocks within it stay."""
    needle = escaped(find_text)
    ends = F.sequence(F.lit(1), F.size(F.split(needle, r"\s+")))
    groups = F.array_join(F.transform(F.slice(ends, 2, 1 << 30), lambda i: F.concat(F.lit("$"), i - 1)), "")
    new = F.concat(F.lit(HIT), quoted_replacement(escaped(replace_text)), groups)
    return F.regexp_replace(page, page_search_pattern(needle, PAGE_GAP), new)


def hits_marked(text):
    return (F.length(text) - F.length(F.replace(text, F.lit(HIT), F.lit("")))).cast("long")


def without_marks(text):
    return F.replace(text, F.lit(HIT), F.lit(""))


def words(text):
    """Lower-cased words, a word being a run of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)
