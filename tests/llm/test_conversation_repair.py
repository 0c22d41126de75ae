import hashlib
import random
import re
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import conversation_repair as cr
from scriptorium.llm.conversation_repair import (
    cheapest, composed, damage, repair, repair_conversations, repaired_messages, spans, with_all,
)

SCHEMA = "conv_id long, turn long, role string, text string, key string, cost string, spans string"
FAULTS = (cr.SOUND, cr.CUT, cr.BLANK)


def every_repair(rows, inserts=2):
    """All ``(cost, audit)`` whose result is legal, by trying all edits."""
    between = [("I" * n, r) for n in range(inserts + 1) for r in product("ua", repeat=n)]
    options = []
    for initial, why in rows:
        own = [(2, "D", "")]
        if why != cr.BLANK:
            extra = 5 if why == cr.CUT else 0
            own += [(extra, "K", initial), (1 + extra, "R", "u"), (1 + extra, "R", "a")]
        options += [own]
    for edits in product(*options):
        for gaps in product(between, repeat=len(rows) + 1):
            audit, roles, cost = gaps[0][0], "".join(gaps[0][1]), 5 * len(gaps[0][0])
            for (more, letter, role), (letters, inserted) in zip(edits, gaps[1:]):
                audit, roles = audit + letter + letters, roles + role + "".join(inserted)
                cost += more + 5 * len(letters)
            if re.fullmatch("(s?(ua)+)?", roles):
                yield cost, audit


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from(FAULTS)), max_size=3))
def test_agenda_finds_the_least_of_all_repairs(rows):
    assert cheapest(rows) == min(every_repair(rows))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from(FAULTS)), max_size=30), st.integers(1, 9))
def test_blocks_give_the_same(rows, block):
    assert cheapest(rows, block) == cheapest(rows, 99)
    if len(rows) > 1:
        at = len(rows) // 2
        assert composed(spans(rows[:at]), spans(rows[at:])) == spans(rows)


def test_by_hand():
    rows = [
        (0, "system", "Be kind."), (0, "user", "Hi."), (0, "user", "Hi."), (1, "assistant", "Hello!"),
        (3, "user", "So"), (4, "user", " \t"), (9, "tool", "Done. "),
    ]
    found = repair(rows)
    assert (found["gaps"], found["blank"], found["duplicate"], found["truncated"]) == (5, 1, 1, 1)
    # su uu ua au uu ut
    assert found["illegal"] == 3
    assert (found["cost"], found["audit"]) == (8, "KKDKDDD")
    text = "system:Be kind.\nuser:Hi.\nassistant:Hello!"
    assert found["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert repair([(None, "user", "Yes.")])["audit"] == "D"
    assert repair([(1, "user", "a."), (2, "user", "b.")])["audit"] == "KR"


def wide(*rows):
    return [(*row, "clash", "clash", "clash") for row in rows]


def messy(rng, conversations, most):
    rows = []
    for i in range(conversations):
        for _ in range(rng.randrange(most)):
            turn = rng.choice([None, *range(most)])
            text = rng.choice([None, "", " ", "Yes.", "no", "Well!", "so? ", "x" * 40, "ü.", "Y\nz."])
            rows.append((i, turn, rng.choice(["user", "assistant", "system", "tool", None]), text))
    return rows


def by_plain_python(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        key = (turn is not None, turn or 0)
        own.setdefault(conv_id, []).append((key, role or " ", " " if text is None else text, turn))
    out = {}
    for conv_id, found in own.items():
        found.sort(key=lambda r: (r[0], r[1].encode(), r[2].encode()))
        out[conv_id] = repair([(turn, role, text) for _, role, text, turn in found])
    return out


@pytest.mark.parametrize("block, hot", [(256, 4096), (2, 5)])
def test_conversations_of_any_size(table, block, hot):
    rng = random.Random(4)
    rows = messy(rng, 12, 14) + [(None, t, "user", "Hm.") for t in range(9)]
    rows += [(77, 3, "assistant", "Same.")] * 12 + [(77, 1, "user", "Go."), (77, 5, "user", " ")]
    source = table(SCHEMA, *wide(*rows))
    want = by_plain_python(rows)
    found = {r["conv_id"]: r for r in repair_conversations(source, block, hot).collect()}
    assert found.keys() == want.keys()
    for conv_id, row in found.items():
        for name, value in row.asDict().items():
            assert name == "conv_id" or value == want[conv_id][name], (conv_id, name)
    texts = {}
    for r in sorted(repaired_messages(source, block, hot).collect(), key=lambda r: r["position"]):
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv_id, row in found.items():
        whole = "\n".join(texts.get(conv_id, []))
        assert row["repaired_sha256"] == hashlib.sha256(whole.encode()).hexdigest()


def test_damage(table, rows):
    source = table(SCHEMA, *wide(*((7, t, "assistant", "One. Two!") for t in (None, *range(200)))))
    import zlib
    found = rows(damage(source))
    want = []
    for turn in (None, *range(200)):
        kind = zlib.crc32(f"7:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: "One Two"}.get(kind, "One. Two!")
        row = (7, turn, "user" if kind == 4 else "assistant", text)
        want += [row] * {0: 0, 3: 2}.get(kind, 1)
    assert found == sorted(want, key=repr)


def test_every_conversation_has_a_row(table):
    source = table(SCHEMA, *wide((None, None, None, None), (3, 1, "user", "Hi.")))
    found = {r["conv_id"]: r for r in with_all(repair_conversations(source.limit(0)), source).collect()}
    assert set(found) == {None, 3}
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["cost"], r["audit"], r["repaired_sha256"]) for r in found.values()} == {(0, "", empty)}
    assert with_all(repair_conversations(source.limit(0)), source.limit(0)).count() == 0
    one = {r["conv_id"]: r for r in repair_conversations(source).collect()}
    assert one[None]["audit"] == "D" and one[None]["blank"] == 1 and one[None]["gaps"] == 0
