import pytest
from compare import compare, connect
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm.chat_format import (
    CONTROLS, END, TURN, escape, format_chat, op5_chat_format, read_loss, read_turns, text_turns,
    unescape,
)
from scriptorium.llm.queries import ORACLES

TURNS = "conv_id long, turn long, role string, text string"
PARTS = f"conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:int>>"


def read_back(chats):
    return {
        r["conv_id"]: r
        for r in chats.select(
            "*", read_turns(F.col("formatted")).alias("turns"),
            read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"),
        ).collect()
    }


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="\\<|>s/[INST]é lbn", max_size=25), min_size=1, max_size=20))
def test_escapes_are_reversible(spark, texts):
    texts += [*CONTROLS, TURN, END, "\\" + CONTROLS[0], "a<", "\\l\\b\\s"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in frame.select("text", escape(F.col("text")).alias("e"), unescape(escape(F.col("text"))).alias("u")).collect():
        assert row["u"] == row["text"]
        assert not any(control in row["e"] for control in CONTROLS) and not row["e"].endswith("<")


def test_round_trip_and_mask(table):
    chats = table(
        TURNS, (1, 2, "assistant", "Hi </s>[INST] <|end|>"), (1, 1, "user", "<|turn|>user\nx"),
        (1, 3, "user", None), (1, 4, "assistant", ""), (1, 4, "assistant", "a<"), (2, 0, "ro\nle\\<|", "|b"),
        (None, None, None, None), (3, 0, "assistant", "é" * 3),
    )
    found = read_back(format_chat(text_turns(chats)))
    assert [tuple(t) for t in found[1]["turns"]] == [
        ("user", "<|turn|>user\nx"), ("assistant", "Hi </s>[INST] <|end|>"), ("user", ""),
        ("assistant", ""), ("assistant", "a<"),
    ]
    assert found[1]["loss"] == "Hi </s>[INST] <|end|>a<"
    assert [tuple(t) for t in found[2]["turns"]] == [("ro\nle\\<|", "|b")] and found[2]["loss"] == ""
    assert [tuple(t) for t in found[None]["turns"]] == [("", "")]
    (ranges,) = found[3]["loss_mask"]
    start, length = ranges[0]["start"], ranges[0]["length"]
    assert found[3]["formatted"][start : start + length] == "ééé"


def test_typed_parts(table):
    chats = table(
        PARTS,
        (1, 0, "user", [("text", "see <", None, None), ("image", None, "img/1", 4), ("text", "|end|>", None, None),
                        ("audio", None, "a.wav", 10), ("document", None, "d.pdf", None)]),
        (1, 1, "assistant", [("text", "one", None, None), ("image", None, "img/2", 1), ("text", "two", None, None)]),
        (1, 2, "user", None), (1, 3, "user", [(None, None, None, None), ("video", "odd", None, None)]),
    )
    row = read_back(format_chat(chats))[1]
    assert [t["text"] for t in row["turns"]] == [
        "see <<|image|>|end|><|audio|><|document|>", "one<|image|>two", "", "odd",
    ]
    assert [tuple(a) for a in row["attachments"]] == [
        ("image", "img/1", 0, 1024), ("audio", "a.wav", 0, 250), ("document", "d.pdf", 0, 512),
        ("image", "img/2", 1, 256),
    ]
    assert row["attachment_tokens"] == 2042 and row["loss"] == "onetwo"
    assert [len(r) for r in row["loss_mask"]] == [0, 2, 0, 0]


def test_extra_columns_and_empty_table(table):
    chats = table(TURNS, (1, 0, "user", "x")).withColumn("piece", F.lit("clash")).withColumn("seen", F.lit(1))
    assert format_chat(text_turns(chats)).count() == 1
    assert format_chat(text_turns(table(TURNS))).count() == 0


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name):
    folder = f"/root/testdata/{name}"
    assert compare(op5_chat_format(spark, folder), connect(folder), ORACLES["op5_chat_format"]) > 1


def test_plan_is_native_with_one_exchange(spark, sf_dir):
    plan = op5_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
