from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexlake.functions import arrays
from lexlake.operators import keyed, records


def test_span_is_found_at_its_first_place_only(spark):
    rows = [([5, 6, 7, 6, 7], [6, 7]), ([5], [5, 6]), ([5, 6], []), ([1, 2], [9]), ([4], [4])]
    df = spark.createDataFrame(rows, "ids array<int>, target array<int>")
    at = arrays.find_span(F.col("ids"), F.col("target"))
    size = F.size("target")
    got = df.select(
        at.alias("at"),
        arrays.mask_span(F.col("ids"), at, size, 99).alias("masked"),
        arrays.span_labels(F.col("ids"), at, size).alias("labels"),
    ).collect()
    assert [tuple(r) for r in got] == [
        (2, [5, 99, 99, 6, 7], [-100, 6, 7, -100, -100]),
        (None, [5], [-100]),
        (None, [5, 6], [-100, -100]),
        (None, [1, 2], [-100, -100]),
        (1, [99], [4]),
    ]


def test_vocabulary_ids_are_dense_and_by_count(spark):
    texts = ["b b b a a c", "d e f g", "B"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["token"]: (r["n"], r["id"]) for r in records.build_vocab(df, "text").collect()}
    assert {k: n for k, (n, _) in got.items()} == Counter("b b b a a c d e f g b".split())
    assert sorted(i for _, i in got.values()) == list(range(3, 10))
    assert got["b"][1] == 3 and got["a"][1] == 4


@pytest.mark.parametrize("bound", [500_000, 2])
def test_encode_pads_cuts_and_marks_unknown(spark, monkeypatch, bound):
    monkeypatch.setattr(keyed, "BROADCAST_ROWS", bound)
    vocab = spark.createDataFrame([("a", 3), ("b", 4), ("c", 5)], "token string, id int")
    df = spark.createDataFrame([(1, "a z b"), (2, ""), (3, "a b c a b c"), (4, None)], "i int, text string")
    got = {r["i"]: (r["input_ids"], r["attention_mask"]) for r in records.encode(df, "i", "text", vocab, 4).collect()}
    assert got == {
        1: ([3, 1, 4, 0], [1, 1, 1, 0]),
        2: ([0, 0, 0, 0], [0, 0, 0, 0]),
        3: ([3, 4, 5, 3], [1, 1, 1, 1]),
        4: ([0, 0, 0, 0], [0, 0, 0, 0]),
    }


def test_random_mask_share_and_labels(spark):
    df = spark.range(400).select("id", F.transform(F.sequence(F.lit(1), F.lit(50)), lambda x: x + 10).alias("ids"))
    df = df.withColumn("keep", F.transform("ids", lambda x: F.when(x <= 50, 1).otherwise(0)))
    masked = arrays.mask_random(F.col("ids"), F.col("keep"), F.col("id"), 0.15, 42, 2)
    rows = df.withColumn("m", masked).withColumn("l", arrays.masked_labels(F.col("ids"), F.col("m"), 2)).collect()
    hits = sum(x == 2 for r in rows for x in r["m"])
    assert 0.13 < hits / (400 * 40) < 0.17
    for r in rows:
        for x, m, lab, k in zip(r["ids"], r["m"], r["l"], r["keep"]):
            assert (m, lab) in ((2, x), (x, -100)) and (k == 1 or m == x)
    again = df.repartition(3).withColumn("m", masked).collect()
    assert {r["id"]: r["m"] for r in rows} == {r["id"]: r["m"] for r in again}


def test_causal_labels_ignore_padding(spark):
    df = spark.createDataFrame([([3, 4, 0], [1, 1, 0])], "ids array<int>, keep array<int>")
    assert df.select(arrays.causal_labels(F.col("ids"), F.col("keep"))).first()[0] == [3, 4, -100]


def test_layouts(spark):
    df = spark.createDataFrame([("Syn", "mot", "n.m.", ["terme", "x"]), ("Syn", "mot", "n.m.", [])], "lf string, name string, pos string, t array<string>")
    got = df.select(
        records.instruction_record(F.col("lf"), F.col("name"), F.col("pos")).alias("q"),
        records.first_target(F.col("t"), F.lit("raw")).alias("a"),
        records.mask_sentence(F.col("lf"), F.col("name"), F.col("pos"), F.lit(" terme ")).alias("s"),
    ).collect()
    assert got[0]["q"] == "Quelle est la cible pour la fonction lexicale 'Syn' du terme 'mot' (n.m.) ?"
    assert [r["a"] for r in got] == ["terme", "raw"]
    assert got[0]["s"] == "Fonction lexicale : Syn. Terme : mot (n.m.). Cible : terme."
    shown = df.select(*[records.chat_layout(x, F.lit("q"), F.lit("a")) for x in ("inst", "chatml")], records.chat_layout("text", F.lit("t"))).first()
    assert tuple(shown) == ("<s>[INST] q [/INST] a </s>", "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>", "<s> t </s>")


def test_conversation_is_one_text(spark):
    rows = [("c", i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(25)]
    df = spark.createDataFrame(rows, "c string, turn long, role string, text string")
    (row,) = records.render_conversation(df, "c", "turn", "role", "text").collect()
    assert row["rendered"].endswith("<|im_start|>assistant\n") and row["rendered"].count("<|im_end|>") == 25
