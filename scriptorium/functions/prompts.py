"""Typed slots of edit prompts, Column to Column, by a grammar of commands.

A prompt is one command, with the page it is limited to before or behind it. Slots that a command has
no place for are null.
"""

from pyspark.sql import functions as F

# Words of the grammar. Matching ignores case; blank runs count as one blank.
QUOTED = "[\"'“”‘’]"
TERM = f"(?:{QUOTED}([^\"“”]+?){QUOTED}|([^\"'“”‘’]+?))"
END = r"[.!]?\z"
PAGE_BEFORE = r"(?i)^(?:on|in) (?:the )?page (\d{1,9})[,:]? "
PAGE_BEHIND = r"(?i),? (?:on|in|from|of) (?:the )?page (\d{1,9})" + END
OBJECT = "(?:the )?(?:(?:word|words|text|phrase|name) )?"
REPLACE = f"(?i)^(?:replace|change|substitute) {OBJECT}{TERM} (?:with|by|to|into|for) {OBJECT}{TERM}{END}"
DELETE = f"(?i)^(?:delete|remove|erase|drop) (?:all )?{OBJECT}{TERM}{END}"
SIZE = r"(\d{1,4}(?:\.\d{1,3})?) ?(?:pt|pts|points?)?"
VERB = "(?:set|change|make|use|switch)"
FONT = (
    rf"(?i)^{VERB} (?:the )?font(?: name| family| face)?(?: to| as)? {QUOTED}?([a-z][a-z ]*?){QUOTED}?"
    rf"(?:,? (?:(?:at|in|with|and) )?(?:size )?{SIZE})?{END}"
)
FONT_SIZE = rf"(?i)^{VERB} (?:the )?(?:font|text) size(?: to| as)? {SIZE}{END}"
ALIGN = (
    rf"(?i)^(?:align (?:the )?(?:text |paragraphs? |document )?(?:to )?(?:the )?(left|right|center|centre)"
    rf"|(center|centre|justify) (?:the )?(?:text|paragraphs?|document)){END}"
)


def _plain(prompt):
    return F.trim(F.regexp_replace(prompt, r"[\s\x{a0}]+", " "))


def _group(text, pattern, *groups):
    """The first of the groups that holds something, else null."""
    found = [F.regexp_extract(text, pattern, g) for g in groups]
    return F.coalesce(*(F.when(x != "", x) for x in found))


def prompt_slots(prompt):
    """Struct of action and slots; null where the prompt is no command.

    ``page`` counts from 1 as readers do. An action is ``change_font`` (name, size or both),
    ``align_text``, ``delete_text`` or ``replace_text``.
    """
    def slots(whole):
        page = F.coalesce(_group(whole, PAGE_BEFORE, 1), _group(whole, PAGE_BEHIND, 1)).cast("long")
        text = F.regexp_replace(F.regexp_replace(whole, PAGE_BEFORE, ""), PAGE_BEHIND, "")
        return _once(text, lambda text: _once(_action(text), lambda action: _slots(text, action, page)))

    found = _once(_plain(prompt), slots)
    return F.when(found["action"].isNotNull(), found)


def _once(value, use):
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _action(text):
    return (
        F.when(text.rlike(FONT_SIZE) | text.rlike(FONT), "change_font")
        .when(text.rlike(ALIGN), "align_text")
        .when(text.rlike(DELETE), "delete_text")
        .when(text.rlike(REPLACE), "replace_text")
    )


def _slots(text, action, page):
    def only(wanted, value):
        return F.when(action == wanted, value)

    resized = text.rlike(FONT_SIZE)
    size = F.coalesce(_group(text, FONT_SIZE, 1), _group(text, FONT, 2))
    side = F.lower(_group(text, ALIGN, 1, 2))
    old = F.coalesce(
        only("replace_text", _group(text, REPLACE, 1, 2)), only("delete_text", _group(text, DELETE, 1, 2))
    )
    return F.struct(
        action.alias("action"), old.alias("old_text"),
        only("replace_text", _group(text, REPLACE, 3, 4)).alias("new_text"), page.alias("page"),
        only("change_font", F.when(~resized, _group(text, FONT, 1))).alias("font_name"),
        only("change_font", size).cast("double").alias("font_size"),
        only("align_text", F.when(side == "centre", "center").otherwise(side)).alias("alignment"),
    )
