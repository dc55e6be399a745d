import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexlake.llm import chat

TEXTS = st.lists(
    st.sampled_from(["<|im_start|>", "<|im_sep|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "~", "<", "[", "|", "a", "\n", "$1", "\\", "<~s>", "é"]),
    max_size=8,
).map("".join)


def rounds(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, extra string")
    return {r["conv_id"]: r for r in chat.format_conversations(df).withColumn("masked", chat.masked_text()).collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(convs=st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a<s>"]), TEXTS), min_size=1, max_size=4), min_size=1, max_size=20))
def test_round_trip_and_mask(spark, convs):
    rows = [(c, n, role, text, "x") for c, turns in enumerate(convs) for n, (role, text) in enumerate(turns)]
    found = rounds(spark, rows)
    for c, turns in enumerate(convs):
        r = found[c]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["masked"] == "".join(t for role, t in turns if role == "assistant")
        marks = (chat.TURN, chat.BODY, chat.END)
        assert [r["formatted"].count(m) for m in marks] == [len(turns)] * 3
        assert not any(x in r["formatted"] for x in chat.CONTROLS if x not in marks)


def test_plain_text_is_not_escaped(spark):
    r = rounds(spark, [(1, 0, "user", "a < b [c] <~ d", "")])[1]
    assert r["formatted"] == "<|im_start|>user<|im_sep|>a < b [c] <~ d<|im_end|>\n"


def test_nulls_ties_order_and_repeats(spark):
    rows = [(1, 1, "b", "2", None), (1, 1, "a", "9", None), (1, 0, None, None, None), (1, 1, "a", "9", None), (None, None, "user", "u", None)]
    found = rounds(spark, rows)
    assert [(t["role"], t["text"]) for t in found[1]["turns"]] == [("", ""), ("a", "9"), ("a", "9"), ("b", "2")]
    assert [(t["role"], t["text"]) for t in found[None]["turns"]] == [("user", "u")]


def test_long_text_and_no_rows(spark):
    text = "<s> word " * 50000
    r = rounds(spark, [(1, 0, "assistant", text, "")])[1]
    assert r["masked"] == text
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(empty).count() == 0


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.format_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<~s>", "<|im_end|>\n"])
def test_probe_texts(spark, text):
    r = rounds(spark, [(-1, 0, "user", text, ""), (-1, 1, "assistant", text, "")])[-1]
    assert hashlib.sha256(r["masked"].encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()
