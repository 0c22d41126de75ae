"""Content tables, edits, runs and reconstruction."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import edits as ed
from scriptorium.operators import evaluate, reconstruct, style
from scriptorium.operators import replace as rep
from scriptorium.plans import fixtures as fx
from scriptorium.sources import content

DOCS = "doc_id long, text string"
PARAGRAPHS = "doc_id long, idx long, text string, scope string"
RAW_BLOCKS = "doc_id long, page_num long, block_no long, block_type int, text string"
EDITS = "doc_id long, seq long, idx long, page_num long, block_no long, text string"
RUNS = (
    "doc_id long, idx long, scope string, run_no long, text string, "
    "font_name string, font_size double"
)


def test_empty_paragraphs_are_kept(table, rows):
    docs = table(DOCS, (1, "a\n\nb"), (2, ""))
    assert rows(content.content_paragraphs(docs)) == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (2, 0, "")]


def test_blocks_keep_their_gaps_and_blank_pages_show(table, rows):
    raw = table(
        RAW_BLOCKS, (1, 0, 0, 0, "x"), (1, 0, 1, 0, "  "), (1, 0, 2, 1, "img"), (1, 0, 3, 0, " y\t"),
        (1, 1, 0, 0, " "),
    )
    pages = table("doc_id long, page_num long", (1, 0), (1, 1), (2, 0))
    blocks = content.content_blocks(pages, raw)
    assert rows(blocks, "doc_id", "page_num", "block_no", "text") == [
        (1, 0, 0, "x"), (1, 0, 3, "y"), (1, 1, None, None), (2, 0, None, None)
    ]
    assert rows(content.document_stats(pages, blocks)) == [(1, 2, 2, 1, False), (2, 1, 0, 1, True)]


def test_nested_pages_are_flattened(table, rows):
    nested = table(
        "doc_id long, pages array<struct<page_num: long, "
        "blocks: array<struct<bbox: array<double>, text: string, block_no: long>>>>",
        (1, [(0, [([0.0, 0.0, 1.0, 1.0], "a", 0), ([0.0, 1.0, 1.0, 2.0], "b", 2)]), (1, [])]),
    )
    assert rows(content.nested_blocks(nested), "page_num", "block_no", "text") == [
        (0, 0, "a"), (0, 2, "b"), (1, None, None)
    ]


def test_last_edit_of_a_paragraph_wins(table, rows):
    paragraphs = table(PARAGRAPHS, (1, 0, "a", "body"), (1, 1, "b", "body"), (1, 2, "c", "body"))
    edits = table(
        EDITS, (1, 2, 0, None, None, "q"), (1, 1, 0, None, None, "p"), (1, 3, 1, None, None, "b"),
        (1, 4, 9, None, None, "z"), (1, 5, None, None, None, "z"), (1, 6, 2, None, None, ""),
    )
    edited = ed.apply_paragraph_edits(paragraphs, edits)
    assert rows(edited, "idx", "new_text", "changed") == [
        (0, "q", True), (1, "b", False), (2, "", True)
    ]
    again = edited.select("doc_id", "idx", F.col("new_text").alias("text"), "scope")
    assert rows(ed.apply_paragraph_edits(again, edits), "idx", "new_text", "changed") == [
        (0, "q", False), (1, "b", False), (2, "", False)
    ]
    assert rows(ed.edit_counts(paragraphs, edits)) == [(1, 6, 4, 2)]


def test_edits_reach_body_paragraphs_only(table, rows):
    paragraphs = table(
        PARAGRAPHS, (1, 0, "b0", "body"), (1, 0, "t0", "table"), (1, 1, "h1", "header"), (1, 1, "b1", "body"),
    )
    edits = table(EDITS, (1, 1, 0, None, None, "GOOD"), (1, 2, 0, None, None, None), (1, 3, 1, None, None, "x"))
    edited = ed.apply_paragraph_edits(paragraphs, edits)
    assert sorted(rows(edited, "scope", "idx", "new_text", "changed")) == [
        ("body", 0, "GOOD", True), ("body", 1, "x", True), ("header", 1, "h1", False), ("table", 0, "t0", False),
    ]
    assert rows(ed.edit_counts(paragraphs, edits)) == [(1, 3, 2, 2)]
    catalog = table("doc_id long, file_type string", (1, "docx"))
    blocks = table("doc_id long, page_num long, block_no long, text string")
    assert rows(content.content_all(catalog, paragraphs, blocks), "idx", "text") == [(0, "b0"), (1, "b1")]
    assert rows(reconstruct.reconstruct_documents(paragraphs)) == [(1, "b0\nb1")]


def test_block_edits_need_an_existing_page(table, rows):
    blocks = table("doc_id long, page_num long, block_no long, text string", (1, 0, 0, "a"), (1, 0, 1, "b"))
    edits = table(EDITS, (1, 1, None, 0, 0, "x"), (1, 2, None, 0, 0, "y"), (1, 3, None, 1, 0, "z"))
    edited = ed.apply_block_edits(blocks, edits)
    assert rows(edited, "block_no", "new_text", "changed") == [(0, "y", True), (1, "b", False)]


def test_reasons_against_edits(table, rows):
    catalog = table("doc_id long, file_type string", (1, "docx"), (2, "pdf"), (3, "txt"))
    pages = table("doc_id long, page_num long", (2, 0))
    edits = table(
        EDITS + ", bbox array<double>",
        (1, 1, 0, None, None, "a", None), (1, 2, None, 0, 0, "a", [1.0]),
        (2, 3, None, 0, 0, "", [1.0]), (2, 4, None, 0, None, "a", [1.0]),
        (2, 5, None, 1, 0, "a", [1.0]), (2, 6, None, -1, 0, "a", [1.0]),
        (2, 7, None, 0, 0, "a", []), (2, 8, None, 0, 0, "a", None), (2, 9, None, 0, 0, None, [1.0]),
        (3, 10, 0, 0, 0, "a", [1.0]), (4, 11, 0, 0, 0, "a", [1.0]),
    )
    checked = ed.checked_edits(
        edits.withColumn("bbox", F.when(F.col("doc_id") == 1, F.array(F.lit(1.0))).otherwise(F.col("bbox"))),
        catalog, pages,
    )
    assert dict(rows(checked, "seq", "reason")) == {
        1: "", 2: "no_index", 3: "", 4: "no_address", 5: "no_such_page", 6: "no_such_page",
        7: "no_region", 8: "no_region", 9: "no_text", 10: "unsupported", 11: "unsupported",
    }
    assert rows(checked.where("valid"), "seq") == [(1,), (3,)]


def test_match_may_span_runs(table, rows):
    runs = table(
        RUNS,
        (1, 0, "body", 0, "Dra", "Arial", 10.0), (1, 0, "body", 1, "ft v", "Courier", 9.0),
        (1, 0, "body", 2, "2", None, None), (1, 1, "body", 0, "Draft", "Arial", None),
        (1, 0, "table", 0, "x", None, None),
    )
    replaced = rep.cross_run_replace(runs, "Draft v2", "Final")
    assert rows(replaced) == [
        (1, 0, "body", 0, "Final", "Arial", 10.0, 1), (1, 0, "body", 1, "", "Courier", 9.0, 1),
        (1, 0, "body", 2, "", None, None, 1), (1, 0, "table", 0, "x", None, None, 0),
        (1, 1, "body", 0, "Draft", "Arial", None, 0),
    ]


def test_runs_of_headers_stay_and_hidden_text_is_found(table, rows):
    runs = table(RUNS, (1, 0, "body", 0, "see ", "Arial", 10.0), (1, 0, "header", 0, "Draft", None, None))
    paragraphs = table(
        PARAGRAPHS, (1, 0, "see Draft", "body"), (1, 0, "Draft", "header"), (1, 1, "Draft", "body"),
    )
    replaced = rep.cross_run_replace(runs, "Draft", "Final", paragraphs=paragraphs)
    assert sorted(rows(replaced, "scope", "idx", "run_no", "text", "font_name", "matches"), key=repr) == sorted([
        ("body", 0, 0, "see Final", "Arial", 1), ("body", 1, 0, "Final", None, 1), ("header", 0, 0, "Draft", None, 0),
    ], key=repr)


def test_edited_paragraph_without_runs_gets_one(table, rows):
    runs = table(RUNS, (1, 0, "body", 0, "a", "Arial", 10.0), (1, 0, "body", 1, "b", None, None))
    paragraphs = table(PARAGRAPHS, (1, 0, "ab", "body"), (1, 1, "", "body"))
    edits = table(EDITS, (1, 1, 0, None, None, "new"), (1, 2, 1, None, None, "more"))
    edited = ed.edit_runs(runs, ed.apply_paragraph_edits(paragraphs, edits))
    assert rows(edited, "idx", "run_no", "text", "font_name") == [
        (0, 0, "new", "Arial"), (0, 1, "", None), (1, 0, "more", None)
    ]


def test_reconstruction_returns_the_documents(spark, sf_dir, table, rows):
    docs = fx.documents(spark, sf_dir)
    whole = reconstruct.reconstruct_documents(content.content_paragraphs(docs))
    assert rows(whole, "doc_id", "text") == rows(docs, "doc_id", "text")
    gap = table("doc_id long, idx long, text string", (1, 2, "c"), (1, 0, "a"), (1, 1, None))
    assert rows(reconstruct.reconstruct_documents(gap), "text") == [("a\n\nc",)]


def test_replacing_text_by_itself_changes_nothing(spark, sf_dir):
    paragraphs = fx.paragraphs(spark, sf_dir)
    same = rep.find_replace(paragraphs, "the", "the")
    assert same.where("new_text <> text").isEmpty()
    longer = rep.find_replace(paragraphs, "the", "there")
    grown = F.length("new_text") - F.length("text")
    assert longer.where(grown != 2 * F.col("matches")).isEmpty()


def test_stack_of_one_rule_is_one_replacement(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    stacked = rep.edit_stack(docs, [("que", "QUE")])
    single = rep.find_replace(docs, "que", "QUE").select("doc_id", F.col("new_text").alias("text"), "matches")
    assert stacked.exceptAll(single.select(*stacked.columns)).isEmpty()


RUN = "run_no long, text string, font_name string, font_size double"
OWN_RUNS = f"doc_id long, scope string, idx long, text string, runs array<struct<{RUN.replace(' long', ':long').replace(' string', ':string').replace(' double', ':double')}>>"
WITH_RUNS = [
    (1, "body", 0, "Draft v2 x", [(0, "Draft ", "Arial", 11.0), (1, "v2 x", None, None)]),
    (1, "body", 1, "", []),
    (1, "table", 0, "Draft v2", [(3, "Draft", "Arial", None), (5, " v2", "Times", 9.0)]),
    (1, "header", 0, "Draft v2", [(0, "Draft v2", None, 9.0)]),
    (2, "body", 0, "link Draft v2", None),
    (2, "body", 1, None, [(0, None, None, None)]),
]


@pytest.fixture
def own_runs(table):
    return table(OWN_RUNS, *WITH_RUNS)


@pytest.fixture
def flat_runs(own_runs):
    return own_runs.select("doc_id", "scope", "idx", F.inline("runs"))


def test_paragraphs_with_their_runs_equal_rows_of_runs(own_runs, flat_runs, rows):
    paragraphs = own_runs.drop("runs")
    nested = rep.cross_run_replace(own_runs, "draft V2", "Final", False)
    flat = rep.cross_run_replace(flat_runs, "draft V2", "Final", False, paragraphs=paragraphs)
    assert rows(nested) == rows(flat, *nested.columns) and len(rows(nested)) == 7
    edits = own_runs.select("doc_id", "idx", F.col("idx").alias("seq"), F.lit("new").alias("text"))
    nested = ed.edit_runs(ed.apply_paragraph_edits(own_runs, edits))
    flat = ed.edit_runs(flat_runs, ed.apply_paragraph_edits(paragraphs, edits))
    assert rows(nested) == rows(flat, *nested.columns)
    assert {r[4] for r in rows(nested) if r[1] == "body"} == {"new", ""}


def test_styles_of_paragraphs_with_their_runs(own_runs, flat_runs, table, rows):
    patches = table(
        "doc_id long, seq long, font_name string, font_size double, header_text string, footer_text string",
        (1, 1, "Arial", 11.0, None, None),
    )
    after, flat_after = style.apply_run_style(own_runs, patches), style.apply_run_style(flat_runs, patches)
    assert rows(after.select("doc_id", "scope", "idx", F.inline("runs"))) == rows(flat_after)
    kept = rows(evaluate.style_preservation(own_runs, after))
    assert kept == rows(evaluate.style_preservation(flat_runs, flat_after)) == [(1, 5, 2, 0.4), (2, 1, 1, 1.0)]
    # other order, a run that is gone and one that is new
    moved = after.withColumn("runs", F.reverse(F.filter("runs", lambda r: r["run_no"] != 3)))
    added = F.struct(F.lit(9).cast("long"), F.lit("n"), F.lit("Arial"), F.lit(1.0)).cast(after.schema["runs"].dataType.elementType)
    moved = moved.withColumn("runs", F.concat(F.array(added), "runs"))
    assert rows(evaluate.style_preservation(own_runs, moved)) == rows(
        evaluate.style_preservation(flat_runs, moved.select("doc_id", "scope", "idx", F.inline("runs")))
    )
