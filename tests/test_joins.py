import random

import pytest
from pyspark.sql import functions as F

from lexlake.functions import arrays
from lexlake.operators import joins, profile


def test_contain_join_against_brute_force(spark):
    rnd = random.Random(4)
    words = ["le", "la", "chat", "chaton", "noir", "é", "l'eau", "ring", "ring-bolt", "x1y", "..", "a b"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 12))) for _ in range(150)]
    targets = [" ".join(rnd.choices(words, k=rnd.randint(1, 5))) for _ in range(80)]
    targets += ["ch", "hat n", "é", "'", "..", " ", "n", "ing", "g-b", "1", "on noir le", "zzz", "", texts[0][1:-1] or "q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    wanted = spark.createDataFrame(list(enumerate(targets)), "t int, target string")
    got = {tuple(r) for r in joins.contain_join(docs, "d", "text", wanted, "t", "target").collect()}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(targets) if b and b in a}
    assert got == want


def test_contain_join_of_long_targets_only(spark):
    docs = spark.createDataFrame([(1, "un chat noir dort"), (2, "un chat blanc")], "d int, text string")
    wanted = spark.createDataFrame([(7, "n chat noir d"), (8, "un chat b")], "t int, target string")
    got = {tuple(r) for r in joins.contain_join(docs, "d", "text", wanted, "t", "target").collect()}
    assert got == {(1, 7), (2, 8)}


@pytest.mark.parametrize("rows", [1000, 1])
def test_decode_list_inside_the_row_and_by_join(spark, rows):
    codes = spark.createDataFrame([(1, "(a,b,a)"), (2, "()"), (3, None), (4, "zz"), (5, "(b,zz)")], "i int, code string")
    names = spark.createDataFrame([("a", "alpha"), ("b", "beta")], "id string, name string")
    got = {r["i"]: r["out"] for r in joins.decode_list(codes, "code", names, "out", ["i"], rows=rows).collect()}
    assert got == {1: ["alpha", "beta", "alpha"], 2: None, 3: None, 4: ["zz"], 5: ["beta", "zz"]}


def test_scalar_decode_gives_null_for_unknown(spark):
    df = spark.createDataFrame([("a",), ("q",), (None,)], "c string")
    names = spark.createDataFrame([("a", "alpha")], "id string, name string")
    assert sorted((r["c"] or "", r["n"]) for r in joins.decode(df, "c", names, "n").collect()) == [("", None), ("a", "alpha"), ("q", None)]


def test_self_lookup_takes_the_last_definition(spark):
    names = spark.createDataFrame([("n1", "old", 0), ("n1", "new", 1), ("n2", "two", 2)], "id string, name string, row int")
    edges = spark.createDataFrame([("n1",), ("n2",), ("n9",)], "target string")
    got = {r["target"]: r["t"] for r in joins.self_lookup(edges, "target", names, "id", "name", "row", "t").collect()}
    assert got == {"n1": "new", "n2": "two", "n9": None}


def test_self_lookup_takes_only_names_that_are_referred_to(spark, monkeypatch):
    seen, written = {}, joins.written

    def record(df, label):
        seen[label] = written(df, label)
        return seen[label]

    monkeypatch.setattr(joins, "written", record)
    names = spark.createDataFrame([(f"n{i % 50}", f"w{i}", i) for i in range(100)] + [(None, "none", 200)], "id string, name string, row int")
    edges = spark.createDataFrame([("n1",), ("n2",), ("n2",), ("n99",), (None,)], "target string")
    got = sorted((str(r["target"]), r["t"]) for r in joins.self_lookup(edges, "target", names, "id", "name", "row", "t").collect())
    assert got == [("None", None), ("n1", "w51"), ("n2", "w52"), ("n2", "w52"), ("n99", None)]
    assert {r["target"] for r in seen["names"].collect()} == {"n1", "n2"}


def test_listed_values_go_and_null_stays(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert {r["c"] for r in joins.drop_listed(df, "c", ["a"]).collect()} == {"b", None}


def test_skip_report(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "lf string")
    templates = spark.createDataFrame([("a", "p")], "lf string, pattern string")
    assert [tuple(r) for r in joins.skipped_keys(df, templates, "lf").collect()] == [("b", 2)]


def test_column_checks(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="missing columns: prompt, task"):
        joins.require_columns(df, ["id", "task", "prompt"])
    assert joins.require_columns(df, ["id"]) is df
    assert joins.first_existing(df, ["answer", "id"]) == "id" and joins.first_existing(df, ["x"]) is None
    assert joins.ensure_column(df, "EM", 0).first()["EM"] == 0 and joins.ensure_column(df, "id", 0) is df


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(1, [("Syn", "a"), ("Anti", "b"), ("Syn", "c")]), (2, [("Rare", "x")]), (3, []), (4, None), (5, [("", "q"), ("Syn", ""), ("Syn", None)])]
    return spark.createDataFrame(rows, "i int, l array<struct<lf:string,target:string>>").cache()


@pytest.mark.parametrize("rows", [1000, 0])
def test_filter_elements_inside_the_row_and_by_join(spark, nodes, rows):
    keys = spark.createDataFrame([("Syn",), ("Anti",)], "k string")
    got = {r["i"]: [tuple(x) for x in r["l"]] for r in profile.filter_elements(nodes, "l", "lf", keys, ["i"], rows=rows).collect()}
    assert got == {1: [("Syn", "a"), ("Anti", "b"), ("Syn", "c")], 2: [], 3: [], 4: [], 5: [("Syn", ""), ("Syn", None)]}


def test_explode_keeps_empty_lists_and_flatten_drops_blanks(nodes):
    assert joins.explode_struct(nodes, "l").count() == 9
    flat = {tuple(r) for r in joins.flatten_relations(nodes, "l", "lf", "target").collect()}
    assert flat == {(1, "Syn", "a"), (1, "Anti", "b"), (1, "Syn", "c"), (2, "Rare", "x")}


def test_duplicates_pair_with_the_first(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"t{i}") for i in range(1, 60)] + [(100, None), (101, None)]
    df = spark.createDataFrame(rows, "i int, c string")
    got = joins.duplicate_content(df, "i", "c").collect()
    assert {(r["i"], r["first_id"]) for r in got} == {(i, 3) for i in range(6, 60, 3)}


def test_corpus_filter_cuts_after_the_length_test(spark):
    df = spark.createDataFrame([(" " + "a" * 49 + " ",), ("b" * 50,), ("é" * 5000,)], "text string")
    assert sorted(len(r["text"]) for r in joins.corpus_filter(df, "text").collect()) == [50, 4000]


def test_nonempty_and_keys(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "\xa0"), (None, "b")], "x string, y string")
    assert joins.require_nonempty(df, ["x", "y"]).count() == 1
    assert [r[0] for r in df.select(joins.group_key("x", "y")).collect()] == ["a||b", "a||\xa0", None]


def test_array_expressions(spark):
    df = spark.createDataFrame([([3, 1], [9], None)], "a array<int>, b array<int>, c array<int>")
    z = df.select(arrays.zip_padded(a=F.col("a"), b=F.col("b"), c=F.col("c")).alias("z")).first()["z"]
    assert [tuple(x) for x in z] == [(3, 9, None), (1, None, None)]
    items = spark.createDataFrame([([(2, "x"), (1, "y"), (1, "z"), (None, "n")],), ([],), ([(None, "only")],)], "l array<struct<position:int,t:string>>")
    best = [r["b"] and r["b"]["t"] for r in items.select(arrays.best_element(F.col("l"), "position").alias("b")).collect()]
    assert best == ["y", None, "only"]
    lists = spark.createDataFrame([([f"w{i}" for i in range(20)],)], "l array<string>")
    p = lists.select(arrays.permute(F.col("l"), 42).alias("p")).first()["p"]
    assert sorted(p) == sorted(f"w{i}" for i in range(20)) and p != [f"w{i}" for i in range(20)]


def test_profile_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), (None, 3), ("c", 4)], "k string, x int")
    assert [tuple(r) for r in profile.value_counts(df, "k").collect()] == [("a", 2), ("b", 1), ("c", 1)]
    assert {r["k"]: r["share"] for r in profile.value_shares(df, "k").collect()} == {"a": 0.5, "b": 0.25, "c": 0.25}
    assert [tuple(r) for r in profile.null_profile(df).collect()] == [("k", 1), ("x", 1)]
    assert {tuple(r) for r in profile.top_n_other(df, "k", 1).collect()} == {("a", 2), ("Other", 2)}
    bins = profile.histogram(df, "x", 2).orderBy("bin").collect()
    assert [(r["lower"], r["upper"], r["n"]) for r in bins] == [(1.0, 2.5, 2), (2.5, 4.0, 2)]


def test_combinations_are_multisets(spark):
    rows = [(1, "B"), (1, "A"), (1, "A"), (2, "A"), (2, "A"), (2, "B"), (3, "A"), (4, "rare")]
    df = spark.createDataFrame(rows, "i int, lf string")
    got = [tuple(r) for r in profile.combination_counts(df, "i", "lf", 2, 20).collect()]
    assert got == [("A + A + B", 2), ("A", 1)]


def test_median_of_lengths(spark):
    df = spark.createDataFrame([("a",), ("bbb",), ("cc",), ("dddddd",), (None,)], "t string")
    r = profile.length_summary(df, F.length("t")).first()
    assert tuple(r) == (4, 3.0, 2.5, 6, 1)
