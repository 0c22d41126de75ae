"""Canonical tables derived from the supplied Parquet tables.

Every function takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the whole of
its input. ``oracles.FIXTURES`` states the same tables in SQL.
"""

from pyspark.sql import functions as F

from scriptorium.functions.audit import content_action
from scriptorium.operators.history import history_append, upload_entries
from scriptorium.session import spread
from scriptorium.sources.content import content_paragraphs, valid_blocks

BLOCKS_PER_PAGE = 20


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column, *values, default=None):
    """Value by remainder: ``column % len`` picks from ``values``."""
    choice = F.lit(default)
    for remainder, value in enumerate(values):
        hit = F.pmod(column, F.lit(len(values))) == remainder
        choice = F.when(hit, F.lit(value)).otherwise(choice)
    return choice


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def catalog(spark, sf_dir):
    doc_id = F.col("doc_id")
    suffix = _case(doc_id, ".pdf", ".docx", ".DOCX", ".txt", "")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        doc_id.alias("seq"),
        F.concat(F.lit("doc_"), doc_id, suffix).alias("name"),
        _case(doc_id, "pdf", "docx", "docx", "txt", None).alias("file_type"),
        (F.col("n_chars") * 1000).alias("size_bytes"),
        F.col("source").alias("owner_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (doc_id % 30).cast("int")).alias(
            "upload_date"
        ),
        F.when(doc_id % 7 != 0, doc_id % 4).alias("images_count"),
    )


def lines(spark, sf_dir):
    return content_paragraphs(documents(spark, sf_dir))


def paragraphs(spark, sf_dir):
    """Of six lines four are body paragraphs; every scope counts its own from 0."""
    line, group = F.col("idx"), F.floor(F.col("idx") / 6).cast("long")
    scope = _case(line, "body", "body", "body", "body", "header", "table")
    idx = F.when(line % 6 < 4, group * 4 + line % 6).otherwise(group)
    return lines(spark, sf_dir).select("doc_id", idx.alias("idx"), "text", scope.alias("scope"))


def raw_blocks(spark, sf_dir):
    idx, block_no = F.col("idx"), F.col("idx") % BLOCKS_PER_PAGE
    text = (
        F.when(block_no == 3, "  ")
        .when(block_no == 5, F.concat(F.lit(" "), F.col("text"), F.lit("\t")))
        .otherwise(F.col("text"))
    )
    return lines(spark, sf_dir).select(
        "doc_id",
        F.floor(idx / BLOCKS_PER_PAGE).cast("long").alias("page_num"),
        block_no.alias("block_no"),
        F.when(block_no == 7, 1).otherwise(0).alias("block_type"),
        text.alias("text"),
    )


def doc_pages(spark, sf_dir):
    """Pages of the blocks and one blank page more, counted without unfolding the blocks."""
    last = F.size(F.split("text", "\n")) - 1
    extra = F.floor(last / BLOCKS_PER_PAGE).cast("long") + 1
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), extra)).alias("page_num")
    )


def paragraph_runs(spark, sf_dir):
    """Paragraphs with their ``runs``, as a document holds them: a run per word and its blanks."""
    pieces = F.regexp_extract_all("text", F.lit(r"(\S+\s*|\s+)"), 1)
    runs = F.transform(pieces, lambda piece, no: F.struct(
        no.cast("long").alias("run_no"),
        piece.alias("text"),
        _case(no, "Arial", "Times New Roman", None).alias("font_name"),
        F.when(no % 2 == 0, 11.0).alias("font_size"),
    ))
    return paragraphs(spark, sf_dir).withColumn("runs", runs)


def runs(spark, sf_dir):
    pieces = F.regexp_extract_all("text", F.lit(r"(\S+\s*|\s+)"), 1)
    rows = paragraphs(spark, sf_dir).select(
        "doc_id", "idx", "scope", F.posexplode(pieces).alias("pos", "text")
    )
    return rows.select(
        "doc_id",
        "idx",
        "scope",
        F.col("pos").cast("long").alias("run_no"),
        "text",
        _case(F.col("pos"), "Arial", "Times New Roman", None).alias("font_name"),
        F.when(F.col("pos") % 2 == 0, 11.0).alias("font_size"),
    )


def paragraph_fonts(spark, sf_dir):
    """Paragraphs with their runs, without any texts."""
    fields = (F.col(f"runs.{c}").alias(c) for c in ("run_no", "font_name", "font_size"))
    return paragraph_runs(spark, sf_dir).select("doc_id", "scope", "idx", F.arrays_zip(*fields).alias("runs"))


def edits_of(events):
    """Edits from event rows; a projection, so it also runs on a stream."""
    event_id = F.col("event_id")
    return events.select(
        F.col("user_id").alias("doc_id"),
        event_id.alias("seq"),
        F.when(event_id % 13 != 0, event_id % 5).alias("idx"),
        F.when(event_id % 11 != 0, event_id % 3).alias("page_num"),
        (event_id % BLOCKS_PER_PAGE).alias("block_no"),
        F.concat(F.lit("edit "), event_id).alias("text"),
    )


def edits(spark, sf_dir):
    return edits_of(table(spark, sf_dir, "events"))


def boxed_blocks(spark, sf_dir):
    """Blocks in four columns; those of two documents of three reach into the next column."""
    no = F.col("block_no")
    x, y = no % 4 * 150.0, F.floor(no / 4) * 40.0
    box = F.array(x, y, x + 140 + F.col("doc_id") % 3 * 20, y + 30)
    return valid_blocks(raw_blocks(spark, sf_dir)).withColumn("bbox", box)


def region_edits(spark, sf_dir):
    """Regions from a point to several columns wide; a fifth of them is empty."""
    n = F.col("event_id")
    x, y = (n * 37 % 600).cast("double"), (n * 53 % 220).cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), (n % 3).alias("page_num"), n.alias("seq"),
        F.array(x, y, x + n % 5 * 60, y + 10 + n % 7 * 30).alias("bbox"),
        F.when(n % 11 != 0, F.concat(F.lit("region edit "), n)).alias("text"),
    )


def accounts(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").where(F.col("source") != "src3")
    return sources.select(F.col("source").alias("user_id")).distinct()


def _known_ids(spark, sf_dir):
    """Documents and a fifth as many; counted as part of the query that uses it."""
    count = table(spark, sf_dir, "documents").select(F.count("*")).scalar()
    return F.floor(count * 6 / 5).cast("long")


def requests(spark, sf_dir):
    """Requests over all documents and a fifth as many unknown ids."""
    event_id = F.col("event_id")
    doc_id = event_id * 7 % _known_ids(spark, sf_dir)
    owner = F.concat(F.lit("src"), doc_id % 20)
    other = F.concat(F.lit("src"), F.col("user_id") % 25)
    return table(spark, sf_dir, "events").select(
        event_id.alias("request_id"),
        doc_id.alias("doc_id"),
        F.when(event_id % 2 == 0, owner).otherwise(other).alias("user_id"),
    )


def signups(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    email = F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email")
    once = customer.select(F.col("c_custkey").alias("seq"), email, F.col("c_name").alias("name"))
    again = customer.where("c_custkey % 5 = 0").select(
        (F.col("c_custkey") + 1000000).alias("seq"),
        email,
        F.concat("c_name", F.lit(" again")).alias("name"),
    )
    return once.unionByName(again)


def known_emails(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    return known.select(F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"))


def images(spark, sf_dir):
    """A picture's place is its line number, then its part number, as one integer."""
    line = F.col("l_linenumber").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.floor(line / 3).cast("long").alias("page_num"),
        (line * 1000000000000 + F.col("l_partkey")).alias("pos"),
        F.col("l_partkey").alias("part_id"),
    )


def image_requests(spark, sf_dir):
    key = F.col("o_orderkey")
    image = F.when(key % 17 == 0, "").otherwise(F.concat(F.lit("img"), key))
    return table(spark, sf_dir, "orders").select(
        key.alias("doc_id"),
        key.alias("seq"),
        (key % 6 - 1).alias("target_index"),
        image.alias("image"),
    )


def section_list(spark, sf_dir):
    numbers = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(numbers).alias("section_no"))


def sections(spark, sf_dir):
    """Two sections with two header and two footer paragraphs; none in every tenth document."""
    numbers = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    parts = F.array(F.lit("header"), F.lit("footer"))
    listed = section_list(spark, sf_dir).where("doc_id % 10 <> 0")
    by_part = listed.withColumn("part", F.explode(parts))
    rows = by_part.withColumn("para_no", F.explode(numbers))
    return rows.withColumn("text", F.concat_ws(" ", "part", "para_no"))


def style_patches(spark, sf_dir):
    doc_id = F.col("doc_id")
    names = ("Times New Roman", "Courier New", "Calibri", "", None)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        doc_id.alias("seq"),
        _case(doc_id, *names).alias("font_name"),
        _case(doc_id, 12.0, 0.0, None).alias("font_size"),
        _case(doc_id, "New header", "", None, None).alias("header_text"),
        _case(doc_id, "New footer", *[None] * 5).alias("footer_text"),
    )


def commands(spark, sf_dir):
    user_turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    word = F.regexp_extract("text", "([A-Za-z]+)", 1)
    is_text = F.col("conv_id") % 3 == 0
    new_word = F.concat(word, F.lit("_new"))
    prompt = F.concat(
        F.lit('Replace "'), word, F.lit('" with "'), new_word, F.lit('".')
    )
    return user_turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("command_id"),
        F.col("conv_id").alias("doc_id"),
        F.when(is_text, F.col("text")).otherwise(prompt).alias("prompt"),
        F.when(~is_text, word).alias("gold_find"),
        F.when(~is_text, new_word).alias("gold_replace"),
    )


def prompts(spark, sf_dir):
    """A prompt per user's turn, of six kinds by number, with its slots; others are plain texts."""
    user_turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    command_id = F.col("conv_id") * 1000 + F.col("turn")
    word = F.regexp_extract("text", "([A-Za-z]+)", 1)
    page, size = F.col("conv_id") % 3 + 1, F.col("turn") + F.lit(8.5)
    new = F.concat(word, F.lit("_new"))

    def text(*parts):
        return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))

    none = F.lit(None)
    kinds = (
        (text('Replace "', word, '" with "', new, '" on page ', page, "."), "replace_text", word, new, page, none, none, none),
        (text("Delete the word ", word), "delete_text", word, none, none, none, none, none),
        (text("Set the font to Courier New ", size, " pt"), "change_font", none, none, none, F.lit("Courier New"), size, none),
        (text("make the  font size ", size, " on page ", page), "change_font", none, none, page, none, size, none),
        (text("Align the text to the right!"), "align_text", none, none, none, none, none, F.lit("right")),
        (text("On page ", page, ", change ", word, " to ", new), "replace_text", word, new, page, none, none, none),
    )
    kind = F.when(word != "", (F.col("conv_id") + F.col("turn")) % (len(kinds) + 1))
    names = ("action", "old_text", "new_text", "page", "font_name", "font_size", "alignment")
    types = ("string", "string", "string", "long", "string", "double", "string")
    columns = []
    for i, (name, cast) in enumerate(zip(("prompt", *names), ("string", *types))):
        value = F.col("text") if name == "prompt" else F.lit(None).cast(cast)
        for number, slots in enumerate(kinds):
            own = F.lit(slots[i]) if isinstance(slots[i], str) else slots[i]
            value = F.when(kind == number, own.cast(cast)).otherwise(value)
        columns.append(value.alias(name if name == "prompt" else f"gold_{name}"))
    return user_turns.select(command_id.alias("command_id"), F.col("conv_id").alias("doc_id"), *columns)


def rule_columns(doc_id):
    return (
        _case(doc_id, "the", "que", "$", "en", "").alias("find_text"),
        _case(doc_id, "$1", "\\1", "a\\b").alias("replace_text"),
        (doc_id % 2 == 0).alias("case_sensitive"),
    )


def rules(spark, sf_dir):
    """Two rules per document, the second on what the first wrote, and one without replacement.

    Every fifth first rule has an empty needle and cannot run.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", *rule_columns(F.col("doc_id")))

    def step(seq, find_text, replace_text, case_sensitive):
        return F.struct(
            F.lit(seq).cast("long").alias("seq"), find_text.alias("find_text"),
            replace_text.alias("replace_text"), case_sensitive.alias("case_sensitive"),
        )

    steps = F.array(
        step(2, F.col("replace_text"), F.lit("z"), F.lit(True)),
        step(3, F.lit("e"), F.lit(None).cast("string"), F.lit(True)),
        step(1, F.col("find_text"), F.col("replace_text"), F.col("case_sensitive")),
    )
    return docs.select("doc_id", F.inline(steps))


def phrase_rules(spark, sf_dir):
    """Two rules for two documents of three: ``and`` becomes ``of``, then ``. the`` of any case, over blocks too."""
    steps = F.array(*(
        F.struct(
            F.lit(seq).cast("long").alias("seq"), F.lit(find).alias("find_text"),
            F.lit(new).alias("replace_text"), F.lit(exact).alias("case_sensitive"),
        )
        for seq, find, new, exact in ((2, ". the", "OT", False), (1, "and", "of", True))
    ))
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 > 0")
    return docs.select("doc_id", F.inline(steps))


def stack_rules(spark, sf_dir):
    """Three rules per document, one reading what another wrote; the last only on even ones."""
    doc_id = F.col("doc_id")
    def step(seq, find_text, replace_text):
        return F.struct(
            F.lit(seq).cast("long").alias("seq"),
            F.lit(find_text).alias("find_text"),
            replace_text.alias("replace_text"),
        )

    steps = F.array(
        step(1, "the", F.lit("THE")),
        step(2, "THE", F.concat(F.lit("x"), doc_id % 3)),
        step(3, "QUE", F.lit("q")),
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", F.inline(steps))
    return rows.where("seq < 3 OR doc_id % 2 = 0").withColumn(
        "case_sensitive", F.col("seq") < 3
    )


def replace_requests(spark, sf_dir):
    """Two requests per document; every fourth first one comes from a fixed user."""
    user = F.when(F.col("doc_id") % 4 == 0, "src1").otherwise(F.col("source"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", user.alias("user"), *rule_columns(F.col("doc_id"))
    )

    def request(no, user_id, find_text, replace_text, case_sensitive):
        return F.struct(
            (F.col("doc_id") * 2 + no).alias("request_id"), user_id.alias("user_id"),
            find_text.alias("find_text"), replace_text.alias("replace_text"),
            case_sensitive.alias("case_sensitive"),
        )

    both = F.array(
        request(1, F.col("source"), F.col("replace_text"), F.lit("z"), F.lit(True)),
        request(0, F.col("user"), F.col("find_text"), F.col("replace_text"), F.col("case_sensitive")),
    )
    return docs.select("doc_id", F.inline(both))


def save_requests(spark, sf_dir):
    """Saves of up to four items each, made from events."""
    save = F.floor(F.col("event_id") / 4).cast("long").alias("request_id")
    saved = table(spark, sf_dir, "events").select(save).distinct()
    doc_id = F.col("request_id") * 7 % _known_ids(spark, sf_dir)
    user = F.when(F.col("request_id") % 3 > 0, doc_no(doc_id, 20)).otherwise(doc_no(doc_id, 25))
    return saved.select("request_id", doc_id.alias("doc_id"), user.alias("user_id"))


def doc_no(doc_id, sources):
    return F.concat(F.lit("src"), doc_id % sources)


def save_items(spark, sf_dir):
    edits = edits_of(table(spark, sf_dir, "events"))
    return edits.select(
        F.floor(F.col("seq") / 4).cast("long").alias("request_id"),
        (F.col("seq") % 4).alias("item_no"),
        "idx", "page_num", "block_no",
        F.when(F.col("seq") % 17 != 0, F.col("text")).alias("text"),
    )


def style_saves(spark, sf_dir):
    """Two style requests per document, the second with an image; every third by another user."""
    doc_id = F.col("doc_id")
    user = F.when(doc_id % 3 > 0, doc_no(doc_id, 20)).otherwise(doc_no(doc_id, 25))
    first = style_patches(spark, sf_dir).select(
        (doc_id * 2).alias("request_id"), "doc_id", user.alias("user_id"), "font_name", "font_size",
        "header_text", "footer_text", F.lit(None).cast("long").alias("image_index"),
        F.lit(None).cast("string").alias("image"),
    )
    second = table(spark, sf_dir, "documents").select(
        (doc_id * 2 + 1).alias("request_id"), "doc_id", doc_no(doc_id, 20).alias("user_id"),
        F.lit(None).cast("string").alias("font_name"), F.lit(9.5).alias("font_size"),
        F.lit(None).cast("string").alias("header_text"), F.lit("Second").alias("footer_text"),
        (doc_id % 4).alias("image_index"), F.concat(F.lit("img"), doc_id).alias("image"),
    )
    return first.unionByName(second)


def history(spark, sf_dir):
    """Uploads and one entry per submitted edit, ordered by ``seq`` in each document."""
    uploaded = upload_entries(catalog(spark, sf_dir), F.lit(-1).cast("long"))
    edited = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"),
        F.col("event_id").alias("seq"),
        F.to_date("ts").alias("date"),
        content_action(F.lit(1)).alias("action"),
    )
    return history_append(uploaded, edited)
