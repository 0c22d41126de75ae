"""Parsing of edit prompts of the form: replace "old" with "new"."""

from pyspark.sql import functions as F

# The prompt grammar and its blanks. The blanks are those of the
# browser's regular expressions, which also count U+FEFF and not U+0085.
BLANK = (
    r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)
QUOTE = "[\"'“”]"
TERM = "([^\"'“”]+?)"
CONNECTIVE = "(?:with|by|to)"

REPLACE_COMMAND = (
    f"(?i)^replace{BLANK}+(?:the{BLANK}+)?{QUOTE}?{TERM}{QUOTE}?{BLANK}+"
    rf"{CONNECTIVE}{BLANK}+{QUOTE}?{TERM}{QUOTE}?\.?{BLANK}*\z"
)


def _trim(column):
    return F.regexp_replace(column, rf"^{BLANK}+|{BLANK}+\z", "")


def parse_replace_command(prompt):
    """Struct ``(find_text, replace_text)``; null unless both terms are non-empty."""
    trimmed = _trim(prompt)
    find_text = _trim(F.regexp_extract(trimmed, REPLACE_COMMAND, 1))
    replace_text = _trim(F.regexp_extract(trimmed, REPLACE_COMMAND, 2))
    return F.when(
        (find_text != "") & (replace_text != ""),
        F.struct(find_text.alias("find_text"), replace_text.alias("replace_text")),
    )
