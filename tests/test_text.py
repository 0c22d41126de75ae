"""Text functions on the edge cases the supplied tables do not contain."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.functions.commands import parse_replace_command
from scriptorium.functions.names import extension
from scriptorium.functions.text import count_caseless, strip_text
from scriptorium.operators import replace as rep

TEXT = "doc_id long, idx long, text string"


def replaced(table, text, find_text, replace_text, **options):
    row = rep.find_replace(table(TEXT, (1, 0, text)), find_text, replace_text, **options).first()
    return row.new_text, row.matches


@pytest.mark.parametrize("replacement", ["C:\\new", "\\1", "$1", "\\d", "$", "a\\Eb"])
@pytest.mark.parametrize("case_sensitive", [True, False])
def test_replacement_is_literal(table, replacement, case_sensitive):
    found = replaced(table, "a cat", "cat", replacement, case_sensitive=case_sensitive)
    assert found == ("a " + replacement, 1)


@pytest.mark.parametrize("needle", [".", "a+", "\\Q", "\\E", "x\\", "[a", "$", "^", "(", "\\Ea\\Q"])
@pytest.mark.parametrize("case_sensitive", [True, False])
def test_needle_is_literal(table, needle, case_sensitive):
    text = f"<{needle}>{needle}.."
    expected = re.subn(re.escape(needle), "_", text, flags=0 if case_sensitive else re.I)
    assert replaced(table, text, needle, "_", case_sensitive=case_sensitive) == expected


@pytest.mark.parametrize(
    "text, find_text, replace_text, expected",
    [("aaa", "aa", "b", ("ba", 1)), ("a", "a", "aa", ("aa", 1)), ("", "a", "b", ("", 0))],
)
def test_matches_do_not_overlap(table, text, find_text, replace_text, expected):
    for case_sensitive in (True, False):
        assert (
            replaced(table, text, find_text, replace_text, case_sensitive=case_sensitive)
            == expected
        )


def test_caseless_matching_is_unicode(table):
    assert replaced(table, "É é", "é", "x", case_sensitive=False) == ("x x", 2)
    assert replaced(table, "i İ ı", "i", "x", case_sensitive=False) == ("x x x", 3)
    for needle in "ßẞ":
        assert replaced(table, "ß ẞ ss", needle, "x", case_sensitive=False) == ("x x ss", 2)
    assert replaced(table, "STRAẞE\\E[ẞ", "aße\\e[", "x", case_sensitive=False) == ("STRxẞ", 1)


def test_letters_meet_all_their_cases(spark, rows):
    """Needle in a literal plan or in a rule, for every letter that has a partner."""
    lower = {}
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        for folded in {c.lower(), c.upper().lower(), c.upper().lower().upper().lower()}:
            lower.setdefault(folded, set()).add(c)
    pairs = {
        (a, b) for group in lower.values() for a in group for b in group
        if a != b and re.fullmatch(re.escape(a), b, re.I)
    }
    pairs |= {pair for a, b in ("ΐΐ", "ΰΰ", "ﬅﬆ") for pair in ((a, b), (b, a))}
    assert len(pairs) > 2900
    found = spark.createDataFrame(sorted(pairs), "x string, y string")
    apart = found.where(count_caseless(F.col("y"), F.col("x")) != 1)
    assert rows(apart, "x", "y") == []


@pytest.mark.parametrize("run", [rep.find_replace, rep.find_replace_blocks, rep.cross_run_replace])
def test_empty_needle_is_an_error(table, run):
    with pytest.raises(ValueError):
        run(table(TEXT, (1, 0, "ab")), "", "X")


def test_empty_needle_in_the_stack_is_an_error(table):
    with pytest.raises(ValueError):
        rep.edit_stack(table(TEXT, (1, 0, "ab")), [("a", "b"), ("", "c")])


def test_empty_needle_in_rules_is_reported_and_skipped(table, rows):
    rules = table(
        "doc_id long, seq long, find_text string, replace_text string, case_sensitive boolean",
        (1, 0, "", "X", True), (2, 0, "b", "c", None), (3, 0, "B", "$0", False), (5, 0, "a", None, True),
        (6, 2, "y", "z", True), (6, 1, "x", "y", True),
    )
    paragraphs = table(
        TEXT, (1, 0, "ab"), (2, 0, "abB"), (3, 0, "abB"), (4, 0, "ab"), (5, 0, "ab"), (6, 0, "x y")
    )
    assert rows(rep.rejected_rules(rules), "doc_id") == [(1,), (5,)]
    counts = rep.matches_by_rule(rep.replace_by_rule(paragraphs, rules).where("doc_id = 6"))
    assert rows(counts, "seq", "matches") == [(1, 1), (2, 2)]
    assert rows(rep.replace_by_rule(paragraphs, rules), "doc_id", "new_text", "matches") == [
        (1, "ab", 0), (2, "acB", 1), (3, "a$0$0", 2), (4, "ab", 0), (5, "ab", 0), (6, "z z", 3)
    ]


@pytest.mark.parametrize(
    "text, needle, case_sensitive, expected",
    [
        ("foo\nbar", "foo bar", False, 1),
        ("foo\nbar", "foo bar", True, 0),
        ("Foo foo", "foo", False, 2),
        ("Foo foo", "foo", True, 1),
        ("see the end", " the", True, 0),
        ("see the end", " the", False, 1),
        ("É é", "é", False, 1),
        ("a+b", "a+b", False, 1),
    ],
)
def test_page_profile(table, text, needle, case_sensitive, expected):
    blocks = table("doc_id long, page_num long, block_no long, text string", (1, 0, 0, text))
    row = rep.find_replace_blocks(blocks, needle, "<$1>", case_sensitive).first()
    assert row.matches == expected
    assert row.new_text.count("<$1>") == expected


def test_page_scope(table, rows):
    blocks = table(
        "doc_id long, page_num long, block_no long, text string", (1, 0, 0, "a"), (1, 1, 0, "a")
    )
    one = rep.find_replace_blocks(blocks, "a", "b", page=1)
    every = rep.find_replace_blocks(blocks, "a", "b")
    assert rows(one, "page_num", "new_text", "matches") == [(0, "a", 0), (1, "b", 1)]
    assert rows(every, "page_num", "new_text") == [(0, "b"), (1, "b")]


@pytest.mark.parametrize("blank", ["\u00a0", "\u001c", "\t", "\u2003", "\u0085", "\u3000", "\x0b"])
def test_strip_removes_every_blank(table, blank):
    row = table("t string", (f"{blank}x{blank}y{blank}",)).select(strip_text(F.col("t"))).first()
    assert row[0] == f"x{blank}y"


def test_strip_equals_python_on_all_low_characters(table):
    texts = [f"{chr(c)}x{chr(c)}" for c in range(1, 0x3100)]
    found = table("t string", *((t,) for t in texts)).select("t", strip_text(F.col("t"))).collect()
    assert [r[0] for r in found if r[1] != r[0].strip()] == []


@pytest.mark.parametrize(
    "name, expected",
    [
        (".pdf", ""), ("..pdf", ""), ("a..pdf", ".pdf"), ("A.DOCX", ".DOCX"), ("pdf", ""),
        ("a.", "."), ("a.b.c", ".c"), ("d.x/name", ""), ("d/.x", ""), ("a.pdf\n", ".pdf\n"),
    ],
)
def test_extension(table, name, expected):
    assert table("name string", (name,)).select(extension(F.col("name"))).first()[0] == expected


@pytest.mark.parametrize(
    "prompt, expected",
    [
        ("replace a to b to c", ("a", "b to c")),
        ('replace "x" with ""', None),
        ("replace it's with its", None),
        ("replace “a” by “b”", ("a", "b")),
        ('  REPLACE the "old text" WITH "new text".  ', ("old text", "new text")),
        ("replace the cat with the dog", ("cat", "the dog")),
        ("replace x with y\n", ("x", "y")),
        ("replace\u00a0x with y", ("x", "y")),
        ("please replace x with y", None),
        ("replace x", None),
        ("", None),
        ("replace a\nb with c", ("a\nb", "c")),
        ("replace 'a' to 'b'..", None),
    ],
)
def test_replace_command(table, prompt, expected):
    found = table("p string", (prompt,)).select(parse_replace_command(F.col("p"))).first()[0]
    assert (found and tuple(found)) == expected


def test_apply_commands(table, rows):
    paragraphs = table(
        "doc_id long, scope string, idx long, text string", (1, "body", 0, "Cat cat"), (1, "table", 0, "DOG"),
        (1, "header", 0, "cat"), (2, "body", 0, "draft"),
    )
    blocks = table("doc_id long, page_num long, block_no long, text string", (3, 0, 0, "of  The end"))
    commands = table(
        "command_id long, doc_id long, prompt string",
        (1, 1, "replace cat with $1"), (2, 1, "replace t\nd by x"), (3, 1, "what is this?"),
        (4, 1, 'Replace "$1" to "\\"'), (5, 9, "replace a with b"), (6, 2, "replace draft with final"),
        (7, 2, "replace FINAL with done"), (8, 3, "replace of the with x"),
    )
    texts, pages, counted = rep.apply_commands(paragraphs, blocks, commands)
    assert sorted(rows(texts, "doc_id", "scope", "new_text")) == [
        (1, "body", "\\ \\"), (1, "table", "DOG"), (2, "body", "done"),
    ]
    assert rows(pages, "new_text", "matches") == [("x end", 1)]
    assert rows(counted, "command_id", "matches") == [(1, 2), (2, 0), (4, 2), (5, 0), (6, 1), (7, 1), (8, 1)]


def test_stack_applies_in_order(table):
    docs = table("doc_id long, text string", (1, "the THE que"))
    row = rep.edit_stack(docs, [("the", "THE"), ("THE", "x"), ("que", "QUE")]).first()
    assert (row.text, row.matches) == ("x x QUE", 4)


def test_stack_of_each_document(table, rows):
    docs = table("doc_id long, text string", (1, "ab"), (2, "ab"), (3, "ab"))
    rules = table(
        "doc_id long, seq long, find_text string, replace_text string, case_sensitive boolean",
        (1, 30, "c", "d", True), (1, 10, "a", "bb", True), (1, 20, "B", "c", False),
        (1, 25, "", "x", True), (2, 5, "B", "x", True), (2, 6, "B", "$1", False),
    )
    expected = [(1, "ddd", 7), (2, "a$1", 1), (3, "ab", 0)]
    found = rep.edit_stack_by_document(docs, rules)
    assert rows(found, "doc_id", "text", "matches") == expected
    assert rows(rep.edit_stack_by_document(docs, rules.limit(0)), "text") == [("ab",)] * 3


BLOCK_ROWS = "doc_id long, page_num long, block_no long, text string, kind string"


def page(*texts, doc_id=1, page_num=0):
    return [(doc_id, page_num, 10 * i, text, "clash") for i, text in enumerate(texts)]


def test_hits_over_blocks_of_a_page_count_once(table, rows):
    blocks = table(BLOCK_ROWS, *page("We sat on", "THE mat on the", "mat"), *page("on the", page_num=1))
    found = rep.find_replace_blocks(blocks, "on the mat", "<$1>", case_sensitive=False)
    assert rows(found, "page_num", "block_no", "new_text", "matches", "kind") == [
        (0, 0, "We sat <$1>", 1, "clash"), (0, 10, " <$1>", 1, "clash"), (0, 20, "", 0, "clash"),
        (1, 0, "on the", 0, "clash"),
    ]
    assert rows(rep.page_totals(found)) == [(1, 0, 2), (1, 1, 0)]
    exact = rep.find_replace_blocks(blocks, "on THE mat", "x")
    assert rows(exact.where("matches > 0"), "block_no") == []
    one = rep.find_replace_blocks(blocks, "on the", "x", case_sensitive=False, page=1)
    assert rows(one, "page_num", "block_no", "matches") == [(0, 0, 0), (0, 10, 0), (0, 20, 0), (1, 0, 1)]


def test_characters_of_the_page_text_are_escaped(table, rows):
    odd = "a\ue000b\ue001c\ue004d"
    blocks = table(BLOCK_ROWS, *page(f"{odd} one", f"two {odd}", "one two"))
    found = rep.find_replace_blocks(blocks, "d one two a\ue000B", odd, case_sensitive=False)
    assert rows(found, "new_text", "matches") == sorted([
        (f"a\ue000b\ue001c\ue004{odd}", 1), ("\ue001c\ue004d", 0), ("one two", 0),
    ], key=repr)


def test_rules_over_blocks_run_in_order(table, rows):
    blocks = table(
        BLOCK_ROWS, *page("red", "car", "red car"), *page("red", "car", doc_id=2), *page("red", "car", doc_id=3),
    )
    rules = table(
        "doc_id long, seq long, find_text string, replace_text string, case_sensitive boolean, page long",
        (1, 2, "Blue  CAR", "bus", False, None), (1, 1, "red", "blue", True, None),
        (2, 1, "red car", "x", False, 7), (3, 1, "car", "x", True, None),
    )
    found = rep.replace_blocks_by_rule(blocks, rules)
    assert rows(found, "doc_id", "block_no", "new_text", "matches") == [
        (1, 0, "bus", 2), (1, 10, "", 0), (1, 20, "bus", 2),
        (2, 0, "red", 0), (2, 10, "car", 0), (3, 0, "red", 0), (3, 10, "x", 1),
    ]
    assert rows(rep.matches_by_rule(found)) == [(1, 1, 2), (1, 2, 2), (3, 1, 1)]


@pytest.mark.parametrize("seed", range(20))
def test_many_rules_equal_the_plain_loop(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(60)]
    # no replacement is longer than its needle, or texts would double with every rule
    rules = [(find, rng.choice([*words, ""])[: len(find)]) for find in rng.choices(words, k=400)]
    automaton = rep.rule_automaton(rules)
    for _ in range(20):
        text = "".join(rng.choices("abcd ", k=rng.randrange(60)))
        want, matches = text, 0
        for find_text, replace_text in rules:
            matches += want.count(find_text)
            want = want.replace(find_text, replace_text)
        assert rep.fold_rules(text, rules, automaton) == (want, matches)


def test_plans_of_many_rules_are_small(table, rows):
    docs = table("doc_id long, text string, matches string", *(
        (*row, "clash") for row in ((1, "the end of the the"), (2, None), (3, ""), (4, "é x77x"))
    ))
    rules = [(f"x{i}x", f"y{i}") for i in range(5000)] + [("y77", "é"), ("the", "THE"), ("THE end", "fin")]
    found = rep.edit_stack(docs, rules)
    assert rows(found) == [(1, "fin of THE THE", 4), (2, None, None), (3, "", 0), (4, "é é", 2)]
    few = rep.edit_stack(docs.drop("matches"), rules[-3:])
    assert rows(few.where("doc_id = 1")) == [(1, "fin of THE THE", 4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 2000


def test_many_rules_hold_few_texts_at_once():
    rules = [(f"w{i}", "x") for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(500), "text": [f"w{i} w1" for i in range(500)]})
    found = list(rep.folded_batches([batch, batch], rules))
    assert max(b.num_rows for b in found) <= rep.TEXTS_AT_ONCE
    rows = [tuple(r.values()) for b in found for r in b.to_pylist()]
    automaton = rep.rule_automaton(rules)
    assert rows == [(i, *rep.fold_rules(f"w{i} w1", rules, automaton)) for i in range(500)] * 2
