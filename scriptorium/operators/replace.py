"""Counted find and replace over paragraphs, blocks, runs and whole documents."""

import sys
from bisect import bisect_right

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from scriptorium.functions.commands import parse_replace_command
from scriptorium.functions.text import (
    BLOCK_END,
    HIT,
    count_caseless,
    count_exact,
    count_matches,
    escaped,
    hits_marked,
    mark_page_hits,
    page_search_pattern,
    quoted_replacement,
    replace_caseless,
    replace_exact,
    replace_matches,
    require_needle,
    strip_text,
    unescaped,
    without_marks,
)
from scriptorium.session import unsorted

# task functions travel with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BODY_AND_TABLES = ["body", "table"]


def find_replace(paragraphs, find_text, replace_text, case_sensitive=True):
    """Add ``new_text`` and ``matches``; needle and replacement are literal."""
    require_needle(find_text)
    text = F.col("text")
    return paragraphs.withColumn(
        "new_text", replace_matches(text, find_text, replace_text, case_sensitive)
    ).withColumn("matches", count_matches(text, find_text, case_sensitive))


def delete_text(paragraphs, find_text, case_sensitive=True):
    return find_replace(paragraphs, find_text, "", case_sensitive)


def replace_body_and_tables(paragraphs, find_text, replace_text, case_sensitive=True):
    """Body and table paragraphs only; headers and footers are not searched."""
    searched = paragraphs.where(F.col("scope").isin(BODY_AND_TABLES))
    return find_replace(searched, find_text, replace_text, case_sensitive)


def replaced_totals(replaced):
    return replaced.groupBy("doc_id").agg(F.sum("matches").alias("matches"))


def _page_profile(text, find_text, replace_text, case_sensitive):
    """New text and count for columns of text and rule; literal rules fold to one branch."""
    pattern = page_search_pattern(find_text)
    caseless = F.regexp_replace(text, pattern, quoted_replacement(replace_text))
    no_outer_blanks = strip_text(find_text) == find_text
    new_text = (
        F.when(~case_sensitive, caseless)
        .when(no_outer_blanks, replace_exact(text, find_text, replace_text))
        .otherwise(text)
    )
    matches = (
        F.when(~case_sensitive, F.regexp_count(text, pattern).cast("long"))
        .when(no_outer_blanks, count_exact(text, find_text))
        .otherwise(0)
    )
    return new_text, matches


PAGE_KEYS = ["doc_id", "page_num"]


def _pages(blocks, *more, **added):
    """One row per page: ``text``, its blocks in order and joined, and the rows of the blocks.

    A page is one value of one row, as it is one page of its document. ``more`` keys part pages
    further; of ``added`` columns, equal in a page, one value is kept.
    """
    others = [c for c in blocks.columns if c not in [*PAGE_KEYS, "block_no", *more, *added]]
    return blocks.groupBy(*PAGE_KEYS, *more).agg(
        F.array_sort(F.collect_list(F.struct("block_no", *others))).alias("_blocks"),
        *(F.any_value(column).alias(name) for name, column in added.items()),
    ).withColumn(
        "text", F.array_join(F.transform("_blocks", lambda b: escaped(b["text"])), BLOCK_END, "")
    )


def _parts(page):
    return F.split(page, BLOCK_END, -1)


def _spans_blocks(find_text, case_sensitive):
    """Can a hit begin in one block of a page and end in another?

    Only where blanks of the needle meet the end of a block, and a case-sensitive hit has to
    equal the needle.
    """
    return ~case_sensitive & strip_text(find_text).rlike(r"\s")


def _replace_on_pages(blocks, find_text, replace_text):
    """Caseless page search whose hits may go on in the following blocks."""
    marked = mark_page_hits(F.col("text"), find_text, replace_text)
    rows = _pages(blocks).select(
        *PAGE_KEYS, F.inline(F.arrays_zip("_blocks", _parts(marked).alias("_new")))
    )
    return rows.select(
        *PAGE_KEYS, "_blocks.*", unescaped(without_marks(F.col("_new"))).alias("new_text"),
        hits_marked(F.col("_new")).alias("matches"),
    ).select(*blocks.columns, "new_text", "matches")


def find_replace_blocks(blocks, find_text, replace_text, case_sensitive=True, page=None):
    """Page profile of find and replace, on one page or, with ``page=None``, on all.

    The search ignores ASCII case and takes any blank run for a blank, also where a block of
    the page ends and the next begins: such a hit counts once, in the block where it begins, which
    gets the replacement; the others lose their share of it. Case-sensitive hits must equal the
    needle once stripped, so a needle with outer blanks has none.
    """
    require_needle(find_text)
    on_page = F.lit(True) if page is None else F.coalesce(F.col("page_num") == page, F.lit(False))
    if not case_sensitive and len(find_text.split()) > 1:
        found = _replace_on_pages(blocks.where(on_page), find_text, replace_text)
        rest = blocks.where(~on_page).withColumns(
            {"new_text": F.col("text"), "matches": F.lit(0).cast("long")}
        )
        return found if page is None else found.unionByName(rest)
    rule = F.lit(find_text), F.lit(replace_text), F.lit(case_sensitive)
    new_text, matches = _page_profile(F.col("text"), *rule)
    return blocks.withColumns(
        {
            "new_text": F.when(on_page, new_text).otherwise(F.col("text")),
            "matches": F.when(on_page, matches).otherwise(0),
        }
    )


def page_totals(replaced):
    """Hits per page; one that goes on in another block counts once."""
    return replaced.groupBy(*PAGE_KEYS).agg(F.sum("matches").alias("matches"))


def rejected_rules(rules):
    """Rules that cannot run: their needle is empty or their replacement null."""
    return rules.where(~_can_run())


def _can_run():
    needle = F.length(F.coalesce("find_text", F.lit(""))) > 0
    return needle & F.col("replace_text").isNotNull()


def _text_profile(text, find_text, replace_text, case_sensitive):
    new_text = F.when(case_sensitive, replace_exact(text, find_text, replace_text)).otherwise(
        replace_caseless(text, find_text, replace_text)
    )
    matches = F.when(case_sensitive, count_exact(text, find_text)).otherwise(
        count_caseless(text, find_text)
    )
    return new_text, matches


def _stacks(rules):
    """The rules of each document that can run, in order of ``seq``, as one array."""
    page = F.col("page") if "page" in rules.columns else F.lit(None).cast("long")
    rule = F.struct(
        "seq", "find_text", "replace_text",
        F.coalesce("case_sensitive", F.lit(True)).alias("exact"), page.alias("page"),
    )
    return rules.where(_can_run()).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(rule)).alias("_stack")
    )


RULE_MATCHES = "array<struct<seq:bigint,matches:bigint>>"


def _folded(content, rules, profile):
    """Run the rules of each row's document over its text, each on the result before it.

    ``rules(doc_id, seq, find_text, replace_text, case_sensitive)`` are gathered once per
    document and met in one join. Adds ``new_text``, ``matches`` and ``rule_matches``, the
    rules that hit with their counts. A rule's ``page``, if any, limits it to that page.
    """
    paged = "page_num" in content.columns

    def step(state, rule):
        new_text, matches = profile(
            state["text"], rule["find_text"], rule["replace_text"], rule["exact"]
        )
        concerned = F.lit(True)
        if paged:
            concerned = rule["page"].isNull() | (rule["page"] == F.col("page_num"))
        hit = concerned & (matches > 0)
        entry = F.array(F.struct(rule["seq"].cast("long").alias("seq"), matches.cast("long").alias("matches")))
        return F.struct(
            F.when(hit, new_text).otherwise(state["text"]).alias("text"),
            F.when(hit, F.concat(state["hits"], entry)).otherwise(state["hits"]).alias("hits"),
        )

    start = F.struct(F.col("text").alias("text"), F.array().cast(RULE_MATCHES).alias("hits"))
    state = F.when(F.col("_stack").isNull(), start).otherwise(F.aggregate("_stack", start, step))
    folded = content.join(_stacks(rules), "doc_id", "left").withColumn("_state", state)
    total = F.aggregate("_state.hits", F.lit(0).cast("long"), lambda n, x: n + x["matches"])
    return folded.select(
        *content.columns, F.col("_state.text").alias("new_text"), total.alias("matches"),
        F.col("_state.hits").alias("rule_matches"),
    )


def replace_by_rule(paragraphs, rules):
    """``rules(doc_id, seq, find_text, replace_text, case_sensitive)`` in order of ``seq``."""
    return _folded(paragraphs, rules, _text_profile)


def replace_blocks_by_rule(blocks, rules):
    """The page profile of rules in order; a rule's ``page``, if any, limits it.

    Blocks and rules meet by document, where they are put together as well: to whole pages in
    documents with a rule whose hits may span blocks, each block by itself in others.
    """
    joined = blocks.join(_stacks(rules), "doc_id", "left")
    spans = F.exists("_stack", lambda rule: _spans_blocks(rule["find_text"], rule["exact"]))
    alone = F.when(~F.coalesce(spans, F.lit(False)), F.col("block_no"))
    return _folded_pages(joined.withColumn("_alone", alone), blocks.columns)


PAGE_MATCHES = "array<struct<seq:bigint,counts:array<bigint>>>"


def _folded_pages(joined, columns):
    """As ``_folded``, over the blocks of a page with the same ``_alone``."""
    def step(state, rule):
        find, new, page = rule["find_text"], rule["replace_text"], state["text"]
        exact = replace_exact(page, escaped(find), F.concat(F.lit(HIT), escaped(new)))
        marked = F.when(~rule["exact"], mark_page_hits(page, find, new)).when(
            strip_text(find) == find, exact
        ).otherwise(page)
        concerned = rule["page"].isNull() | (rule["page"] == F.col("page_num"))
        hit = concerned & (hits_marked(marked) > 0)
        entry = F.array(F.struct(
            rule["seq"].cast("long").alias("seq"),
            F.transform(_parts(marked), hits_marked).alias("counts"),
        ))
        return F.struct(
            F.when(hit, without_marks(marked)).otherwise(page).alias("text"),
            F.when(hit, F.concat(state["hits"], entry)).otherwise(state["hits"]).alias("hits"),
        )

    start = F.struct(F.col("text").alias("text"), F.array().cast(PAGE_MATCHES).alias("hits"))
    folded = _pages(joined, "_alone", _stack=F.col("_stack")).withColumn(
        "_state", F.when(F.col("_stack").isNull(), start).otherwise(F.aggregate("_stack", start, step))
    )
    rows = folded.select(
        *PAGE_KEYS, F.col("_state.hits").alias("_hits"),
        F.posexplode(F.arrays_zip("_blocks", _parts(F.col("_state.text")).alias("_new"))).alias("_i", "_row"),
    )
    own = F.transform("_hits", lambda h: F.struct(
        h["seq"].alias("seq"), F.get(h["counts"], F.col("_i")).alias("matches")
    ))
    rows = rows.withColumn("rule_matches", F.filter(own, lambda h: h["matches"] > 0))
    total = F.aggregate("rule_matches", F.lit(0).cast("long"), lambda n, x: n + x["matches"])
    return rows.select(
        *PAGE_KEYS, "_row._blocks.*", unescaped(F.col("_row._new")).alias("new_text"),
        total.alias("matches"), "rule_matches",
    ).select(*columns, "new_text", "matches", "rule_matches")


def matches_by_rule(*replaced):
    """Matches of each rule ``(doc_id, seq)`` that hit anywhere in the replaced contents."""
    hits = [r.select("doc_id", F.inline("rule_matches")) for r in replaced]
    for other in hits[1:]:
        hits[0] = hits[0].unionByName(other)
    return hits[0].groupBy("doc_id", "seq").agg(F.sum("matches").alias("matches"))


def cross_run_replace(runs, find_text, replace_text, case_sensitive=True, paragraphs=None):
    """Replace over the joined text of each paragraph, so a match may span runs.

    Body and table paragraphs are searched. One with a match gets its whole new text in its
    first run, or in a new run 0 if it has none, and '' in the others, whose styles stay; other
    paragraphs keep their runs. ``paragraphs`` gives their texts where runs do not hold all of
    it, as with links. Adds ``matches`` of the paragraph.

    Paragraphs that come with their ``runs`` (and ``text``) as one row are exchanged nowhere; rows of
    runs are gathered first.
    """
    require_needle(find_text)
    own = runs if "runs" in runs.columns else _gathered(runs)
    if paragraphs is not None:
        texts = paragraphs.where(F.col("scope").isin(BODY_AND_TABLES)).select(*PARAGRAPH_KEYS, "text")
        hit = count_matches(F.col("text"), find_text, case_sensitive) > 0
        own = _join_runs(own.drop("text"), texts.where(hit), "full")
    elif "text" not in own.columns:
        own = own.withColumn("text", F.array_join("runs.text", ""))
    text = F.when(F.col("scope").isin(BODY_AND_TABLES), F.col("text"))
    matches = F.coalesce(count_matches(text, find_text, case_sensitive), F.lit(0)).cast("long")
    new_text = replace_matches(text, find_text, replace_text, case_sensitive)
    found = own.withColumn("matches", matches).withColumn("new_text", F.when(F.col("matches") > 0, new_text))
    shown = rewritten_runs(found, "matches")
    return shown if "runs" in runs.columns else shown.select(*runs.columns, "matches")


PARAGRAPH_KEYS = ["doc_id", "scope", "idx"]


def _gathered(runs):
    """Runs of each paragraph in order, as one array; a paragraph is one value anyway."""
    ordered = ["run_no", *(c for c in runs.columns if c not in [*PARAGRAPH_KEYS, "run_no"])]
    return runs.groupBy(*PARAGRAPH_KEYS).agg(
        F.array_sort(F.collect_list(F.struct(*ordered))).alias("runs")
    )


def joined_apart(paragraphs, join):
    """``join(paragraphs)`` with an array per field of ``runs`` in place of their array of rows.

    Such arrays take less than half the bytes in an exchange, and fields that nothing reads later
    are not exchanged at all.
    """
    fields = paragraphs.schema["runs"].dataType.elementType.names
    apart = paragraphs.select(
        *(c for c in paragraphs.columns if c != "runs"), *(F.col(f"runs.{n}").alias(f"_run_{n}") for n in fields)
    )
    found = join(apart)
    runs = F.arrays_zip(*(F.col(f"_run_{n}").alias(n) for n in fields)).alias("runs")
    return found.select(*(c for c in found.columns if not c.startswith("_run_")), runs)


def _join_runs(own, other, how):
    return joined_apart(own, lambda apart: apart.join(unsorted(other), PARAGRAPH_KEYS, how))


def rewritten_runs(paragraphs, *added):
    """Rows of the ``runs`` of ``paragraphs(doc_id, scope, idx, runs, new_text)``.

    Where there is a new text the first run takes it and the others become empty; a paragraph
    without runs gets one. ``added`` columns go to all runs of the paragraph.
    """
    kind = paragraphs.schema["runs"].dataType
    names = kind.elementType.names
    alone = F.array(F.struct(*(
        {"run_no": F.lit(0), "text": F.col("new_text")}.get(f.name, F.lit(None))
        .cast(f.dataType).alias(f.name) for f in kind.elementType
    ))).cast(kind)
    shown = F.when(F.col("new_text").isNotNull() & (F.coalesce(F.size("runs"), F.lit(0)) <= 0), alone).otherwise(
        F.col("runs")
    )
    rows = paragraphs.select(*PARAGRAPH_KEYS, "new_text", *added, F.posexplode(shown).alias("_at", "_run"))
    text = (
        F.when(F.col("new_text").isNull(), F.col("_run.text"))
        .when(F.col("_at") == 0, F.col("new_text")).otherwise("").alias("text")
    )
    own = (text if n == "text" else F.col(f"_run.{n}") for n in names)
    return rows.select(*PARAGRAPH_KEYS, *own, *added)


def with_new_texts(runs, changed):
    """Carry ``changed(doc_id, scope, idx, new_text)`` over to rows of runs, in one grouping."""
    return rewritten_runs(_join_runs(_gathered(runs), changed, "full")).select(*runs.columns)


# rules up to here become one projection each; more go through one pass over each text
FEW_RULES = 32
# texts of a batch that are in a task's Python at once, beside the batch itself
TEXTS_AT_ONCE = 64


def edit_stack(docs, rules, few=FEW_RULES):
    """Apply ``rules``, a list of ``(find_text, replace_text)``, one after the other.

    Every rule sees the result of the one before. ``matches`` is the total. Nothing is exchanged and
    no job runs ahead. The plan of thousands of rules is as small as that of one: an Aho-Corasick
    automaton tells in one pass over a text which rules can touch it, and only those are run.
    """
    for find_text, _ in rules:
        require_needle(find_text)
    if len(rules) > few:
        return _many_rules(docs, rules)
    current = docs.withColumn("matches", F.lit(0).cast("long"))
    for find_text, replace_text in rules:
        hits = count_exact(F.col("text"), find_text)
        current = current.withColumns(
            {
                "matches": F.col("matches") + hits,
                "text": replace_exact(F.col("text"), find_text, replace_text),
            }
        )
    return current


def _many_rules(docs, rules):
    columns = [c for c in docs.columns if c != "matches"]
    docs = docs.select(*columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    return docs.mapInArrow(lambda batches: folded_batches(batches, rules), f"{kinds}, matches long")


def folded_batches(batches, rules):
    """Batches with ``text`` after all rules and ``matches``, of ``TEXTS_AT_ONCE`` rows at most."""
    automaton = rule_automaton(rules)
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
            batch = whole.slice(at, TEXTS_AT_ONCE)
            done = [fold_rules(text, rules, automaton) for text in batch["text"].to_pylist()]
            texts = pa.array([text for text, _ in done], pa.string())
            columns = batch.schema.names
            own = [texts if c == "text" else batch[c] for c in columns]
            matches = pa.array([n for _, n in done], pa.int64())
            yield pa.RecordBatch.from_arrays([*own, matches], [*columns, "matches"])


def rule_automaton(rules):
    """Automaton of all needles; each tells the numbers of its rules, rising."""
    import ahocorasick

    numbers = {}
    for number, (find_text, _) in enumerate(rules):
        numbers.setdefault(find_text, []).append(number)
    automaton = ahocorasick.Automaton()
    for find_text, own in numbers.items():
        automaton.add_word(find_text, own)
    automaton.make_automaton()
    return automaton


def fold_rules(text, rules, automaton):
    """``(text, matches)`` after all rules in order.

    The next rule to run is the first after the last one whose needle the text has now; a text that
    was changed is read anew, since it may have other needles than before.
    """
    if text is None:
        return None, None
    matches, last = 0, -1
    while True:
        present = sorted({
            n for _, own in automaton.iter(text) for n in own[bisect_right(own, last):]
        })
        if not present:
            return text, matches
        last = present[0]
        find_text, replace_text = rules[last]
        matches += text.count(find_text)
        text = text.replace(find_text, replace_text)


def edit_stack_by_document(docs, rules):
    """Apply to every document its own ``rules(doc_id, seq, find_text, replace_text,
    case_sensitive)`` in ``seq`` order, each on the result of the one before.

    ``matches`` is the total. Nothing is asked of the data ahead.
    """
    folded = _folded(docs, rules, _text_profile)
    return folded.select(*(c for c in docs.columns if c != "text"), F.col("new_text").alias("text"), "matches")


def parsed_commands(commands):
    """Add ``find_text`` and ``replace_text``; both null where the prompt is not understood."""
    parsed = commands.withColumn("parsed", parse_replace_command(F.col("prompt")))
    return parsed.withColumns(
        {
            "find_text": F.col("parsed.find_text"),
            "replace_text": F.col("parsed.replace_text"),
        }
    ).drop("parsed")


def command_rules(commands):
    """The understood commands as caseless rules of the document they target, in their order."""
    return parsed_commands(commands).where(F.col("find_text").isNotNull()).select(
        "doc_id", F.col("command_id").alias("seq"), "find_text", "replace_text",
        F.lit(False).alias("case_sensitive"),
    )


def apply_commands(paragraphs, blocks, commands):
    """Run every understood command over its document, each on the result of those before.

    ``(paragraphs, blocks, matches)``: both contents with ``new_text``, by the profile of their
    format, and one row per command with its number of matches.
    """
    rules = command_rules(commands)
    searched = paragraphs.where(F.col("scope").isin(BODY_AND_TABLES))
    texts, pages = replace_by_rule(searched, rules), replace_blocks_by_rule(blocks, rules)
    counted = rules.join(matches_by_rule(texts, pages), ["doc_id", "seq"], "left").select(
        F.col("seq").alias("command_id"), "doc_id", "find_text", "replace_text",
        F.coalesce("matches", F.lit(0)).cast("long").alias("matches"),
    )
    return texts, pages, counted
