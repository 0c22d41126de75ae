"""Slots of prompts, and what the prompts do."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.prompts import prompt_slots
from scriptorium.operators.prompts import SLOT_NAMES, apply_prompts, parsed_prompts, slot_accuracy

NAMES = ("action", "old_text", "new_text", "page", "font_name", "font_size", "alignment")
PROMPTS = [
    ('Replace "Draft v2" with "Final Submission" on page 3.', ("replace_text", "Draft v2", "Final Submission", 3)),
    ("On page 12, change the word cat to dog", ("replace_text", "cat", "dog", 12)),
    ("replace  it's\tby “that is”", None),
    ('substitute "it\'s" for "that is"', ("replace_text", "it's", "that is")),
    ("Delete the phrase 'for now' from page 2", ("delete_text", "for now", None, 2)),
    ("remove all foo bar!", ("delete_text", "foo bar")),
    ("Set the font to Times New Roman 12 pt", ("change_font", None, None, None, "Times New Roman", 12.0)),
    ('change font family to "Arial"', ("change_font", None, None, None, "Arial")),
    ("Make the font size 10.5 points on page 1", ("change_font", None, None, 1, None, 10.5)),
    ("use font Courier New, size 9", ("change_font", None, None, None, "Courier New", 9.0)),
    ("Align the text to the right.", ("align_text", *[None] * 5, "right")),
    ("justify paragraphs", ("align_text", *[None] * 5, "justify")),
    ("Centre the document", ("align_text", *[None] * 5, "center")),
    ("What does page 3 say?", None), ("", None), (None, None), ("replace x", None), ("delete ", None),
    ("Please do not replace anything", None),
]


@pytest.mark.parametrize("prompt, want", PROMPTS)
def test_slots(spark, prompt, want):
    row = spark.createDataFrame([(prompt,)], "prompt string").select(prompt_slots(F.col("prompt")).alias("s")).first()
    assert (None if row.s is None else tuple(row.s)) == (want and (*want, *[None] * (7 - len(want))))
    assert SLOT_NAMES == NAMES


def prompts(table):
    gold = ", ".join(f"gold_{n} {t}" for n, t in zip(NAMES, ["string"] * 3 + ["long", "string", "double", "string"]))
    rows = [(i, 1, p, *(w or ()), *[None] * (7 - len(w or ()))) for i, (p, w) in enumerate(PROMPTS)]
    return table(f"command_id long, doc_id long, prompt string, {gold}", *rows)


def test_accuracy_by_slot(table, rows):
    found = {r[0]: r[1:] for r in rows(slot_accuracy(prompts(table)), "slot", "n_prompts", "n_exact", "share")}
    assert found == {n: (len(PROMPTS), len(PROMPTS), 1.0) for n in NAMES}
    assert slot_accuracy(prompts(table).limit(0)).where("share IS NULL").count() == 7


def test_prompts_change_documents(table, rows):
    said = table(
        "command_id long, doc_id long, prompt string", (1, 1, "replace red with blue"), (2, 1, "delete 'car' on page 2"),
        (3, 1, "Set font size to 9"), (4, 1, "set the font to Arial"), (5, 2, "delete sky"), (6, 1, "hello"),
        (7, 1, "replace 'blue car' with 'bus'"),
    )
    paragraphs = table("doc_id long, scope string, idx long, text string", (1, "body", 0, "Red car"), (1, "header", 0, "red"), (2, "body", 0, "The SKY"))
    blocks = table("doc_id long, page_num long, block_no long, text string", (1, 0, 0, "red"), (1, 0, 1, "car"), (1, 1, 0, "red car"))
    runs = table("doc_id long, scope string, idx long, run_no long, text string, font_name string, font_size double", (1, "body", 0, 0, "Red car", "Times", 11.0), (2, "body", 0, 0, "The SKY", "Times", 11.0))
    texts, pages, styled, matches = apply_prompts(paragraphs, blocks, runs, said)
    assert rows(texts, "doc_id", "new_text") == [(1, "bus"), (2, "The ")]
    assert rows(pages, "page_num", "block_no", "new_text") == [(0, 0, "bus"), (0, 1, ""), (1, 0, "blue ")]
    assert rows(styled, "doc_id", "font_name", "font_size") == [(1, "Arial", 9.0), (2, "Times", 11.0)]
    assert rows(matches) == [(1, 1, 3), (2, 1, 1), (5, 2, 1), (7, 1, 2)]
    assert parsed_prompts(said).count() == 7
