"""Conversations as training text: typed parts, escaped controls, loss mask. JVM-side only.

A turn becomes ``<|turn|>role`` newline body ``<|end|>``. The body is its parts in order: text
with control strings escaped, and one placeholder ``<|image|>``, ``<|audio|>`` or
``<|document|>`` per attachment. Each attachment is recorded with its reference, its place and
the number of tokens its placeholder expands to. The loss mask covers the text parts of
``LEARNED`` roles, as code point ranges of the formatted text.

Escaping is reversible: backslash becomes ``\\s``, the first character of a control string
``\\l`` or ``\\b``, so no text part holds ``<|``; a newline in a role becomes ``\\n``.

One exchange by conversation serves the running offsets and the gathering. A conversation
is one output row, so its text must fit in one; that is what the format is for.

Edge cases: null text is empty, null role is empty; a turn with null or no parts has an empty
body; a part of unknown type is kept as escaped text; turns of equal number stand in order of
role and text, repeated rows each count; rows without turn number come first; rows without
conv_id form one conversation without id. An empty table gives an empty one.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.llm.tables import load

TURN, END = "<|turn|>", "<|end|>"
LEARNED = ("assistant",)
# fixed values: markers of this template and of common others, escaped by their first character
CONTROLS = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
ESCAPES = {"<": "\\l", "[": "\\b"}
# tokens one unit of an attachment expands to: image tile, second of audio, page of a document
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,ref:string,units:int>"


def escape(text):
    text = F.replace(text, F.lit("\\"), F.lit("\\s"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(ESCAPES[control[0]] + control[1:]))
    # "<" at the end of a part might meet "|" at the start of the next
    return F.when(
        F.endswith(text, F.lit("<")),
        F.concat(text.substr(F.lit(1), F.length(text) - 1), F.lit("\\l")),
    ).otherwise(text)


def unescape(text):
    for plain, escaped in ESCAPES.items():
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return F.replace(text, F.lit("\\s"), F.lit("\\"))


def escape_role(role):
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role):
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def _is_attachment(part):
    return F.coalesce(part["type"].isin(*UNIT_TOKENS), F.lit(False))


def visit(part):
    """What a part is in the text, and what is recorded of it."""
    attachment = _is_attachment(part)
    tokens = reduce(
        lambda rest, kind: F.when(
            part["type"] == kind, F.lit(UNIT_TOKENS[kind]) * F.coalesce(part["units"], F.lit(1))
        ).otherwise(rest),
        UNIT_TOKENS, F.lit(0),
    )
    text = F.when(attachment, F.concat(F.lit("<|"), part["type"], F.lit("|>"))).otherwise(
        escape(F.coalesce(part["text"], F.lit("")))
    )
    return F.struct(
        text.alias("text"), attachment.alias("attachment"), part["type"].alias("type"),
        part["ref"].alias("ref"), F.when(attachment, tokens).otherwise(0).alias("tokens"),
    )


def _loss_ranges(head):
    """Ranges of the text parts in ``seen``, counted from the start of the turn."""
    length = F.length(head)
    before = lambda i: F.aggregate(
        F.slice("seen", 1, i), F.lit(0), lambda n, y: n + F.length(y["text"])
    )
    placed = F.transform(
        "seen",
        lambda x, i: F.struct(
            (length + before(i)).alias("at"), F.length(x["text"]).alias("length"),
            x["attachment"].alias("attachment"),
        ),
    )
    return F.filter(placed, lambda x: ~x["attachment"] & (x["length"] > 0))


def format_chat(turns):
    """``turns(conv_id, turn, role, parts)``, parts an array of ``PART``; one row a conversation.

    ``(conv_id, n_turns, formatted, loss_mask, attachments, attachment_tokens)``. The mask has
    an array of ranges per turn, each with ``start`` in the formatted text and ``at`` in its turn.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    head = F.concat(F.lit(TURN), escape_role(role), F.lit("\n"))
    seen = F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), visit)
    body = F.array_join(F.transform("seen", lambda x: x["text"]), "")
    rows = turns.select("conv_id", "turn", role.alias("role"), seen.alias("seen")).select(
        "conv_id", "turn", "role", "seen", F.concat(head, body, F.lit(END)).alias("piece"),
        F.when(role.isin(*LEARNED), _loss_ranges(head)).alias("learned"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "piece")
    ends = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(
        "*", (ends - F.length("piece")).alias("start"),
        (F.row_number().over(order) - 1).alias("turn_no"),
    )
    mask = F.transform(
        F.coalesce("learned", F.array().cast("array<struct<at:int,length:int,attachment:boolean>>")),
        lambda x: F.struct(
            (F.col("start") + x["at"]).alias("start"), x["length"].alias("length"),
            x["at"].alias("at"),
        ),
    )
    refs = F.transform(
        F.filter("seen", lambda x: x["attachment"]),
        lambda x: F.struct(
            x["type"].alias("type"), x["ref"].alias("ref"), F.col("turn_no").alias("turn_no"),
            x["tokens"].alias("tokens"),
        ),
    )
    row = F.struct("turn_no", "piece", mask.alias("mask"), refs.alias("refs"))
    whole = rows.select("conv_id", row.alias("row")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("row")).alias("rows")
    )
    field = lambda name: F.transform("rows", lambda x: x[name])
    attachments = F.flatten(field("refs"))
    return whole.select(
        "conv_id", F.size("rows").cast("long").alias("n_turns"),
        F.array_join(field("piece"), "").alias("formatted"),
        field("mask").alias("loss_mask"), attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, x: n + x["tokens"]).alias(
            "attachment_tokens"
        ),
    )


def _pieces(formatted):
    """Turns of a formatted text, each without its end mark."""
    pieces = F.split(formatted, _quoted(END), -1)
    return F.slice(pieces, 1, F.size(pieces) - 1)


def _quoted(mark):
    return mark.replace("|", "\\|")


def read_turns(formatted):
    """Array of ``(role, text)`` read back from a formatted text; placeholders stay in it."""
    def turn(piece):
        inner = piece.substr(F.lit(len(TURN) + 1), F.length(piece))
        at = F.instr(inner, "\n")
        return F.struct(
            unescape_role(inner.substr(F.lit(1), at - 1)).alias("role"),
            unescape(inner.substr(at + 1, F.length(inner))).alias("text"),
        )

    return F.transform(_pieces(formatted), turn)


def read_loss(formatted, mask):
    """All text under the loss mask, unescaped, in order."""
    def learned(piece, ranges):
        return F.array_join(
            F.transform(ranges, lambda x: piece.substr(x["at"] + 1, x["length"])), ""
        )

    return unescape(F.array_join(F.zip_with(_pieces(formatted), mask, learned), ""))


# fixed values of the contract: a conversation made of another template's markers
EXTRA = "(-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')"


def text_turns(conversations):
    """Turns with one text part each."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.struct(
        F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("units"),
    )
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def op5_chat_format(spark, sf_dir):
    extra = spark.sql(f"SELECT * FROM VALUES {EXTRA} AS t(conv_id, turn, role, text)")
    given = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = format_chat(text_turns(given.unionByName(extra)))
    chats = chats.select("*", read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    lines = F.transform(
        read_turns(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    )
    return chats.select(
        "conv_id", F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(text):
    sql = f"replace({text}, '\\', '\\s')"
    for control in CONTROLS:
        sql = f"replace({sql}, '{control}', '{ESCAPES[control[0]] + control[1:]}')"
    return sql


OP5_SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, {_sql_escape("text")} AS escaped, {_sql_escape("role")} AS name FROM given
), texts AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    CAST(sum({len(TURN) + len(END) + 1} + length(name) + length(replace(role, chr(10), '__')) - length(role)
      + length(escaped) + CASE WHEN escaped LIKE '%<' THEN 1 ELSE 0 END) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars
FROM texts
"""
