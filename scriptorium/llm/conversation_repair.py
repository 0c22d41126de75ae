"""Cheapest repair of conversations by Knuth's lightest-derivation agenda.

A repaired conversation has the role initials ``(s?(ua)+)?``: nothing, or an optional system
message and alternating pairs of user and assistant. Every row is kept (K, free), given another role
(R, 1) or deleted (D, 2), and empty messages are inserted (I, 5) anywhere; blank rows and
duplicates must go, and a truncated row that stays adds 5.

1. Items of the deduction system are (rows read, last role); a rule reads a row by K, R or D, or
   inserts. A rule's value is a superior function: it adds its cost to that of its item and its
   initial to the item's audit string. Values are compared as (cost, audit). A rule never makes a value
   smaller, and keeps the order of two values of one item: equal costs mean audits of which neither
   begins with the other, since a longer one has paid for its inserts. So an item popped from the agenda
   is final, and the first goal item popped is the cheapest repair with the ASCII-least audit.
2. Up to ``BLOCK`` rows are one run of the agenda. Longer conversations are cut into blocks; one run for
   each role before a block gives the lightest derivation to each role after it, and those spans are
   composed by the same addition of costs and audits.
3. A conversation of up to ``HOT`` rows is one group. The rows of larger ones are put in order by
   range partitioning, so a conversation may lie in any number of tasks; blocks are repaired wherever
   they lie, without texts, and their spans are composed 64 at a time until one is left. Only
   the digest of the repaired text, which has an order, is one stream of rows per conversation.

Rows are taken by turn, nulls first, then by role and text, which only matters where rows share a
turn; equal rows are adjacent. Null roles and texts are one space. Edge cases: a null conv_id is a
conversation like others; a role that begins with none of s, u, a cannot be kept; empty and blank
texts are blank rows; a conversation without rows costs nothing and has the hash of the empty string;
an empty table gives an empty one.
"""

import hashlib
import heapq
import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import functions as F

from scriptorium.llm.tables import load, staged
from scriptorium.operators.skew import look_up

BLOCK = 256
HOT = 4096
FAN = 6  # 2**FAN spans are composed in one task

# Costs of edits, roles by what may follow, legal neighbours.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
GOALS = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, CUT, SOUND = "blank", "duplicate", "truncated", ""

WORD = re.compile(r"[^\x20\x09-\x0D]")
ENDS = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


def fault(role, text, seen):
    """First fault of a row; ``seen`` tells that role and text were there before."""
    if not WORD.search(text):
        return BLANK
    if seen:
        return DUPLICATE
    return SOUND if ENDS.search(text) else CUT


def kept(initial, last):
    """The role after keeping a row with this initial, None where that is illegal."""
    if last == START and initial == "s":
        return SYSTEM
    return FOLLOWS[last] if initial == "sua"[FOLLOWS[last] - 1] else None


def lightest(rows, start=START, goals=None):
    """Agenda over ``rows`` of (initial, fault).

    With ``goals`` the first of them popped after all rows, else all roles after them, as
    ``{role: (cost, audit)}``.
    """
    agenda, final, ends = [(0, "", 0, start)], set(), {}
    while agenda:
        cost, audit, at, last = heapq.heappop(agenda)
        if (at, last) in final:
            continue
        final.add((at, last))
        if at == len(rows):
            ends[last] = cost, audit
            if goals and last in goals:
                return {last: ends[last]}
        for more, letter, item in deductions(rows, at, last):
            if item not in final:
                heapq.heappush(agenda, (cost + more, audit + letter, *item))
    return ends


def deductions(rows, at, last):
    """``(cost, initial, item)`` of the rules that apply to an item."""
    yield INSERT, "I", (at, FOLLOWS[last])
    if at == len(rows):
        return
    initial, why = rows[at]
    yield DELETE, "D", (at + 1, last)
    if why not in (BLANK, DUPLICATE):
        extra = TRUNCATED if why == CUT else 0
        after = kept(initial, last)
        if after is not None:
            yield extra, "K", (at + 1, after)
        yield REROLE + extra, "R", (at + 1, FOLLOWS[last])


def spans(rows):
    """``{(role before, role after): (cost, audit)}`` of a block."""
    return {
        (start, end): value
        for start in (START, SYSTEM, USER, ASSISTANT)
        for end, value in lightest(rows, start).items()
    }


def composed(left, right):
    """Spans of two neighbouring blocks as one."""
    out = {}
    for (start, middle), (cost, audit) in left.items():
        for (begin, end), (more, letters) in right.items():
            if begin == middle:
                value = cost + more, audit + letters
                if (start, end) not in out or value < out[start, end]:
                    out[start, end] = value
    return out


def best(whole):
    """``(cost, audit)`` of the cheapest complete conversation."""
    return min(value for (start, end), value in whole.items() if start == START and end in GOALS)


def cheapest(rows, block=BLOCK):
    """``(cost, audit)`` of rows of (initial, fault)."""
    if len(rows) <= block:
        return next(iter(lightest(rows, START, GOALS).values()))
    whole = None
    for at in range(0, len(rows), block):
        own = spans(rows[at : at + block])
        if whole is None:  # nothing stands before the first block
            own = {(start, end): value for (start, end), value in own.items() if start == START}
        whole = own if whole is None else composed(whole, own)
    return best(whole)


def replay(rows, audit):
    """``(edit, role, text)`` of the repaired messages, from rows of (role, text)."""
    rows, last = iter(rows), START
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        after = kept(role[:1], last) if letter == "K" else FOLLOWS[last]
        yield letter, role if letter == "K" else NAMES[after], text
        last = after


def line(role, text):
    return f"{role}:{text}"


def illegal(initials):
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def repair(rows, block=BLOCK):
    """All results for one conversation, ``rows`` of (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append(fault(role, text, (role, text) in seen))
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    cost, audit = cheapest(list(zip(initials, faults)), block)
    messages = list(replay([(role, text) for _, role, text in rows], audit))
    turns = {turn for turn, _, _ in rows if turn is not None}
    digest = hashlib.sha256("\n".join(line(r, t) for _, r, t in messages).encode())
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{name: faults.count(name) for name in (BLANK, DUPLICATE, CUT)},
        "illegal": illegal(initials), "cost": cost, "audit": audit,
        "repaired_sha256": digest.hexdigest(),
        "messages": [{"edit": e, "role": r, "text": t} for e, r, t in messages],
    }


COUNTS = ("gaps", BLANK, DUPLICATE, CUT, "illegal", "cost")
DIGEST = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
MESSAGES = "messages array<struct<edit:string,role:string,text:string>>"
ARROW_DIGEST = pa.schema([
    ("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS),
    ("audit", pa.string()), ("repaired_sha256", pa.string()),
])
ARROW_REPAIR = ARROW_DIGEST.append(pa.field("messages", pa.list_(pa.struct([
    ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
]))))


def damage(conversations):
    """Rows damaged by the crc32 of conversation and turn: lost, emptied, cut, repeated, misattributed."""
    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = message_rows(conversations, kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(
        F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")
    ).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(copies).alias("_copy"),
    ).drop("_copy")


def message_rows(conversations, *more):
    """``(conv_id, turn, role, text)``; null roles and texts are one space."""
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), *more,
    )


def _key():
    """Never null, so that a null conv_id joins and groups like others."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key")


def _repair(block):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = [
                    {"conv_id": conv_id, **repair([tuple(r.values()) for r in rows], block)}
                    for conv_id, rows in zip(part["conv_id"].to_pylist(), part["rows"].to_pylist())
                ]
                yield pa.RecordBatch.from_pylist(out, ARROW_REPAIR)

    return run


def _plain(rows, block):
    """Conversations that are one group."""
    groups = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows")
    )
    return groups.mapInArrow(_repair(block), f"{DIGEST}, {MESSAGES}")


def _ordered(rows):
    """Rows of hot conversations with ``i``, rising in their order, and their fault; staged.

    Equal rows are one row ``n`` times. The first of a role and text is in its earliest turn.
    """
    rows = rows.groupBy("key", "conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    named = rows.withColumn("print", F.xxhash64("role", "text"))
    first = named.groupBy("key", "role", "text").agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unnumbered"),
    ).select("key", F.col("role").alias("_role"), F.col("text").alias("_text"), "least", "unnumbered",
             F.xxhash64("role", "text").alias("print"))
    found = look_up(named, first, ["key", "print"], "turn").where("role = _role and text = _text")
    earliest = F.when(F.col("unnumbered"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    order = ["key", "turn", "role", "text"]
    dealt = found.select(*order, "conv_id", "n", (~earliest).alias("seen")).repartitionByRange(*order)
    return staged(
        dealt.sortWithinPartitions(*order).withColumn("i", F.monotonically_increasing_id()), "ordered"
    )


SPANS = (
    "key string, at long, rows long, first string, last string, illegal long, blank long, "
    "duplicate long, truncated long, "
    "spans array<struct<start:int,end:int,cost:long,audit:string>>"
)
ARROW_SPANS = pa.schema([
    ("key", pa.string()), ("at", pa.int64()), ("rows", pa.int64()), ("first", pa.string()),
    ("last", pa.string()), ("illegal", pa.int64()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("spans", pa.list_(pa.struct([
        ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()),
    ]))),
])


def _packed(table):
    return [
        {"start": s, "end": e, "cost": cost, "audit": audit} for (s, e), (cost, audit) in table.items()
    ]


def _unpacked(packed):
    return {(s["start"], s["end"]): (s["cost"], s["audit"]) for s in packed}


def _block(rows):
    """Summary of some neighbouring rows, each with ``n`` equal ones in a row."""
    table, singles, initials, wrong = None, [], [], 0
    counts = dict.fromkeys((BLANK, DUPLICATE, CUT), 0)

    def add(own):
        nonlocal table
        table = own if table is None else composed(table, own)

    for r in rows:
        why, more = fault(r["role"], r["text"], r["seen"]), r["n"] - 1
        singles.append((r["role"][:1], why))
        initials.append(r["role"][:1])
        if why:
            counts[why] += 1
        if more:
            counts[BLANK if why == BLANK else DUPLICATE] += more
            wrong += more  # no initial may follow itself
            add(spans(singles))
            add({(q, q): (DELETE * more, "D" * more) for q in (START, SYSTEM, USER, ASSISTANT)})
            singles = []
    if singles:
        add(spans(singles))
    return {
        "rows": sum(r["n"] for r in rows), "first": initials[0], "last": initials[-1],
        "illegal": wrong + illegal(initials), **counts, "spans": _packed(table),
    }


def _joined(parts):
    """Summary of neighbouring summaries."""
    whole = dict(parts[0])
    table = _unpacked(whole["spans"])
    for part in parts[1:]:
        table = composed(table, _unpacked(part["spans"]))
        whole["illegal"] += part["illegal"] + (whole["last"] + part["first"] not in LEGAL)
        whole["last"] = part["last"]
        for name in ("rows", BLANK, DUPLICATE, CUT):
            whole[name] += part[name]
    whole["spans"] = _packed(table)
    return whole


def _summaries(make):
    def run(batches):
        for batch in batches:
            out = [
                {"key": key, "at": at, **make(parts)}
                for key, at, parts in zip(*(batch[c].to_pylist() for c in ("key", "at", "parts")))
            ]
            yield pa.RecordBatch.from_pylist(out, ARROW_SPANS)

    return run


def _composed_spans(ordered, block):
    """One summary per conversation, composed from its blocks level by level."""
    bits = max(1, (block - 1).bit_length())
    level = ordered.groupBy("key", F.shiftright("i", bits).alias("at")).agg(
        F.sort_array(F.collect_list(F.struct("i", "role", "text", "n", "seen"))).alias("parts")
    ).mapInArrow(_summaries(_block), SPANS)
    names = [f.split()[0] for f in SPANS.split(", ")]
    level = staged(level, "spans")
    while level.groupBy("key").count().where("count > 1").limit(1).count():
        level = staged(
            level.groupBy("key", F.shiftright("at", FAN).alias("up")).agg(
                F.sort_array(F.collect_list(F.struct("at", *names[2:]))).alias("parts")
            ).select("key", F.col("up").alias("at"), "parts").mapInArrow(_summaries(_joined), SPANS),
            "spans",
        )
    return level


def _best(batches):
    for batch in batches:
        values = [best(_unpacked(packed)) for packed in batch["spans"].to_pylist()]
        keys = batch["key"]
        yield pa.RecordBatch.from_arrays(
            [keys, pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values])],
            ["key", "cost", "audit"],
        )


def _streamed(emit):
    """Repaired messages of conversations whose rows come in order, the audit first.

    Memory is a batch and one audit. ``emit`` gets a conversation's key and messages lazily.
    """
    def run(batches):
        def events():
            for batch in batches:
                for part in range(0, batch.num_rows, 1024):
                    yield from batch.slice(part, 1024).to_pylist()

        for key, rows in groupby(events(), key=lambda r: r["key"]):
            rows = iter(rows)
            audit = next(rows)["text"]
            pairs = ((r["role"], r["text"]) for r in rows for _ in range(r["n"]))
            yield from emit(key, replay(pairs, audit))

    return run


def _digests(key, messages):
    digest = hashlib.sha256()
    for n, (_, role, text) in enumerate(messages):
        digest.update((("\n" if n else "") + line(role, text)).encode())
    yield pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [digest.hexdigest()]})


def _message_rows(key, messages):
    part = []
    for at, (edit, role, text) in enumerate(messages):
        part.append({"key": key, "position": at, "edit": edit, "role": role, "text": text})
        if len(part) == 1024:
            yield pa.RecordBatch.from_pylist(part, ARROW_MESSAGES)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, ARROW_MESSAGES)


ARROW_MESSAGES = pa.schema([
    ("key", pa.string()), ("position", pa.int64()), ("edit", pa.string()),
    ("role", pa.string()), ("text", pa.string()),
])
MESSAGE_ROWS = "key string, position long, edit string, role string, text string"


def _in_order(ordered, audits):
    """Rows of each conversation in order, behind one that holds its audit."""
    heads = audits.select(
        "key", F.lit(-1).cast("long").alias("i"), F.lit("").alias("role"),
        F.col("audit").alias("text"), F.lit(1).cast("long").alias("n"),
    )
    rows = ordered.select("key", "i", "role", "text", "n").unionByName(heads)
    return rows.repartition("key").sortWithinPartitions("key", "i")


def _hot(rows, block):
    """``(ordered rows, audits, digest columns)`` of conversations of any size."""
    ordered = _ordered(rows)
    whole = _composed_spans(ordered, block)
    audits = staged(whole.select("key", "spans").mapInArrow(_best, "key string, cost long, audit string"), "audits")
    turns = ordered.groupBy("key", "turn").agg(F.max("conv_id").alias("conv_id"))
    gaps = turns.groupBy("key").agg(
        F.max("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
    )
    hashes = _in_order(ordered, audits).mapInArrow(
        _streamed(_digests), "key string, repaired_sha256 string"
    )
    digests = (
        gaps.join(whole.drop("spans", "at", "rows", "first", "last"), "key")
        .join(audits, "key").join(hashes, "key")
    )
    return ordered, audits, digests.select(*ARROW_DIGEST.names)


def _split(rows, hot):
    """Rows of plain and of hot conversations; the few keys of the latter are joined, not listed."""
    rows = rows.select(_key(), "*")
    large = rows.groupBy("key").count().where(F.col("count") > hot).select("key")
    return rows.join(large, "key", "left_anti"), rows.join(large, "key", "left_semi"), large


def repair_conversations(rows, block=BLOCK, hot=HOT):
    """Faults, cost, audit and digest of every conversation with ``rows``."""
    rows = message_rows(rows)
    plain, heavy, large = _split(rows, hot)
    found = _plain(plain, block).drop("messages")
    if large.limit(1).count():
        found = found.unionByName(_hot(heavy, block)[2])
    return found


def repaired_messages(rows, block=BLOCK, hot=HOT):
    """``(conv_id, position, edit, role, text)`` of the repaired conversations."""
    rows = message_rows(rows)
    plain, heavy, large = _split(rows, hot)
    found = _plain(plain, block).select("conv_id", F.posexplode("messages").alias("position", "m"))
    found = found.select("conv_id", F.col("position").cast("long"), "m.edit", "m.role", "m.text")
    if large.limit(1).count():
        ordered, audits, _ = _hot(heavy, block)
        more = _in_order(ordered, audits).mapInArrow(_streamed(_message_rows), MESSAGE_ROWS)
        conv_id = F.when(F.col("key") != " ", F.col("key").cast("long")).alias("conv_id")
        found = found.unionByName(more.select(conv_id, "position", "edit", "role", "text"))
    return found


def with_all(found, conversations):
    """``found`` and a row for each other conv_id: nothing to repair."""
    ids = conversations.select(F.col("conv_id").cast("long")).distinct().select(_key(), "conv_id")
    missing = ids.join(found.select(_key()), "key", "left_anti").select(
        "conv_id", *(F.lit(0).cast("long").alias(c) for c in COUNTS), F.lit("").alias("audit"),
        F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256"),
    )
    return found.unionByName(missing)


def op11_conversation_repair(spark, sf_dir):
    conversations = load(spark, sf_dir, "conversations")
    found = staged(repair_conversations(damage(conversations)), "repairs")
    return with_all(found, conversations)


def _step(state, cost, letter, line):
    return (
        f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || chr(10) || {line}}}"
    )


OP11_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(0, 256), lambda x: list_reduce([x] || range(0, 8), lambda c, r:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), kinds AS (
  SELECT m.conv_id, m.turn, coalesce(m.role, ' ') AS role, coalesce(m.text, ' ') AS text,
    xor(list_reduce([4294967295] || list_transform(string_split(
      coalesce(CAST(m.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(m.turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: xor(t[CAST((xor(c, b) & 255) + 1 AS BIGINT)], c >> 8)), 4294967295) % 20 AS kind
  FROM conversations m, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS x,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
      WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
      WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN '' ELSE 'truncated' END AS fault
  FROM placed
), numbered AS (
  SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before_x FROM judged
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before_x IS NOT NULL AND before_x || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM numbered GROUP BY conv_id
), steps AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS n,
    {{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''}} AS s,
    {_step("{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}", 5, "I", "'user:'")} AS u,
    {_step(_step("{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}", 5, "I", "'user:'"), 5, "I", "'assistant:'")} AS a
  FROM counts
  UNION ALL
  SELECT conv_id, i, n, s,
    list_min([u, {_step("n", 5, "I", "'user:'")}, {_step("s", 5, "I", "'user:'")}, {_step("a", 5, "I", "'user:'")}]) AS u,
    list_min([a, {_step("list_min([u, " + _step("n", 5, "I", "'user:'") + ", " + _step("s", 5, "I", "'user:'") + "])", 5, "I", "'assistant:'")}]) AS a
  FROM (
    SELECT p.conv_id, r.i, {{'c': p.n.c + 2, 'a': p.n.a || 'D', 't': p.n.t}} AS n,
      CASE WHEN stays AND x = 's' THEN list_min([{{'c': p.s.c + 2, 'a': p.s.a || 'D', 't': p.s.t}}, {_step("p.n", "extra", "K", "kept")}])
        ELSE {{'c': p.s.c + 2, 'a': p.s.a || 'D', 't': p.s.t}} END AS s,
      CASE WHEN NOT stays THEN {{'c': p.u.c + 2, 'a': p.u.a || 'D', 't': p.u.t}}
        WHEN x = 'u' THEN list_min([{{'c': p.u.c + 2, 'a': p.u.a || 'D', 't': p.u.t}}, {_step("p.n", "extra", "K", "kept")}, {_step("p.s", "extra", "K", "kept")}, {_step("p.a", "extra", "K", "kept")}])
        ELSE list_min([{{'c': p.u.c + 2, 'a': p.u.a || 'D', 't': p.u.t}}, {_step("p.n", "1 + extra", "R", "'user:' || text")}, {_step("p.s", "1 + extra", "R", "'user:' || text")}, {_step("p.a", "1 + extra", "R", "'user:' || text")}]) END AS u,
      CASE WHEN NOT stays THEN {{'c': p.a.c + 2, 'a': p.a.a || 'D', 't': p.a.t}}
        WHEN x = 'a' THEN list_min([{{'c': p.a.c + 2, 'a': p.a.a || 'D', 't': p.a.t}}, {_step("p.u", "extra", "K", "kept")}])
        ELSE list_min([{{'c': p.a.c + 2, 'a': p.a.a || 'D', 't': p.a.t}}, {_step("p.u", "1 + extra", "R", "'assistant:' || text")}]) END AS a
    FROM steps p JOIN (
      SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra,
        role || ':' || text AS kept FROM numbered) r
    ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = p.i + 1)
), ends AS (
  SELECT conv_id, list_min([n, a]) AS e
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM steps) WHERE back = 1
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost,
  coalesce(e.a, '') AS audit, sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends d ON o.conv_id IS NOT DISTINCT FROM d.conv_id
"""
