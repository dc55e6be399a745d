import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexlake.operators import sampling


def loop_trim(quotas, budget):
    """Take one from the largest, the first in order on ties, until the sum fits."""
    q = dict(quotas)
    while sum(q.values()) > budget:
        top = max(q.values())
        q[next(k for k in q if q[k] == top)] -= 1
    return q


@pytest.mark.parametrize("seed", range(12))
def test_trim_equals_the_loop(spark, seed):
    rnd = random.Random(seed)
    sizes = sorted(((rnd.randint(1, 400), f"c{i:02d}") for i in range(rnd.randint(1, 25))), key=lambda x: (-x[0], x[1]))
    quotas = [(k, n, rnd.randint(0, 60)) for n, k in sizes]
    budget = rnd.choice([0, 1, 7, 60, 300, 5000])
    df = spark.createDataFrame(quotas, "k string, n long, quota long")
    got = {r["k"]: r["quota"] for r in sampling.trim_quotas(df, "k", budget).collect()}
    assert got == loop_trim([(k, q) for k, _, q in quotas], budget)


def test_quotas_round_half_to_even_and_keep_the_floor(spark):
    df = spark.createDataFrame([(k,) for k, n in [("a", 5), ("b", 5), ("c", 0)] for _ in range(n)] + [(None,)] * 3, "k string")
    got = {r["k"]: (r["n"], r["quota"]) for r in sampling.class_quotas(df, "k", 5, 1).collect()}
    assert got == {"a": (5, 2), "b": (5, 2)}  # 2.5 each, half to even
    sizes = {"x": 100, "y": 10, "z": 1}
    df = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "k string")
    total = sum(math.log1p(n) for n in sizes.values())
    want = {k: max(round(math.log1p(n) / total * 50), 8) for k, n in sizes.items()}
    assert {r["k"]: r["quota"] for r in sampling.class_quotas(df, "k", 50, 8).collect()} == want


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(f"g{i}", "hot" if i % 3 == 0 else f"s{i % 17}", f"w{i % 101}") for i in range(3000)]
    return spark.createDataFrame(rows, "id string, k string, w string").cache()


def test_take_gives_min_of_size_and_quota(spark, groups):
    quotas = spark.createDataFrame([("hot", 137), ("s1", 5000), ("s2", 0), ("s3", 1)], "k string, quota long")
    taken = sampling.stratified_take(groups, "k", "id", quotas, 42)
    sizes = Counter(r["k"] for r in groups.collect())
    got = Counter(r["k"] for r in taken.collect())
    assert got == Counter({"hot": 137, "s1": sizes["s1"], "s3": 1})
    again = sampling.stratified_take(groups.repartition(13, "w"), "k", "id", quotas, 42)
    assert {r["id"] for r in taken.collect()} == {r["id"] for r in again.collect()}
    other = sampling.stratified_take(groups, "k", "id", quotas, 7)
    assert {r["id"] for r in taken.collect()} != {r["id"] for r in other.collect()}


def shares(sizes, draws):
    """Largest remainders: (key -> least, key -> most) that ties allow."""
    total = sum(sizes.values())
    whole = {k: n * draws // total for k, n in sizes.items()}
    left, rest = draws - sum(whole.values()), {k: n * draws % total for k, n in sizes.items()}
    cut = sorted(rest.values(), reverse=True)[left - 1] if left else total
    return {k: (whole[k] + (rest[k] > cut), whole[k] + (rest[k] >= cut and left > 0)) for k in sizes}


def test_split_is_exact_disjoint_and_stable(spark, groups):
    split = sampling.stratified_split(groups, "id", "k", 42)
    rows = [tuple(r) for r in split.select("id", "k", "split").collect()]
    assert len(rows) == 3000 == len({r[0] for r in rows})
    assert Counter(r[2] for r in rows) == {"train": 2400, "val": 300, "test": 300}
    sizes = Counter(r["k"] for r in groups.collect())
    got = Counter((k, s) for _, k, s in rows)
    assert all(a <= got[k, "train"] <= b for k, (a, b) in shares(sizes, 2400).items())
    others = {k: n - got[k, "train"] for k, n in sizes.items()}
    assert all(a <= got[k, "val"] <= b for k, (a, b) in shares(others, 300).items())
    again = sampling.stratified_split(groups.repartition(5), "id", "k", 42)
    assert sorted(rows) == sorted(tuple(r) for r in again.select("id", "k", "split").collect())
    assert {r["shared"] for r in sampling.split_overlap(split, "id").collect()} == {0}


def test_split_of_many_small_strata_has_the_overall_sizes(spark):
    # Sizes of a stratified 80/10/10 split that rounds the rest and the test part up.
    ids = spark.range(7003).select("id", F.col("id").cast("int").__mod__(F.lit(1000)).alias("s"))
    got = sampling.stratified_split(ids, "id", "s", 42)
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 5602, "val": 700, "test": 701}
    per = got.where("split = 'train'").groupBy("s").count().agg(F.min("count"), F.max("count")).first()
    assert tuple(per) in {(5, 6), (5, 7)}


def test_split_of_nothing_and_of_one(spark):
    none = sampling.stratified_split(spark.createDataFrame([], "id long, s string"), "id", "s", 1)
    assert none.collect() == [] and none.columns == ["id", "s", "split"]
    assert [tuple(r) for r in sampling.stratified_split(spark.createDataFrame([(1, "a")], "id long, s string"), "id", "s", 1).collect()] == [(1, "a", "test")]


def test_apportioning_stays_exact_beyond_64_bits(spark):
    sizes = [("a", 3 * 10**18), ("b", 10**18 + 1), ("c", 7)]
    draws, total = 4 * 10**18 // 5, sum(n for _, n in sizes)
    df = spark.createDataFrame([((k,), n) for k, n in sizes], "k struct<v string>, n long")
    got = {r["k"]["v"]: r["d"] for r in sampling.apportion(df, "k", "n", draws, F.col("k")["v"], "d").collect()}
    assert sum(got.values()) == draws and all(a <= got[k] <= b for k, (a, b) in shares(dict(sizes), draws).items())
    assert all(abs(got[k] - n * draws / total) <= 1 + n * 1e-9 for k, n in sizes)


def test_overlap_is_found(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "val"), ("b", "test"), ("b", "train"), ("c", "val")], "id string, split string")
    got = {r["pair"]: r["shared"] for r in sampling.split_overlap(df, "id").collect()}
    assert got == {"train-val": 1, "train-test": 1, "val-test": 0}


def test_rows_of_a_group_never_part(spark):
    df = spark.createDataFrame([(f"g{i % 50}", "k", i) for i in range(400)], "id string, k string, x int")
    split = sampling.stratified_split(df, "id", "k", 1)
    assert split.groupBy("id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_holdout_takes_the_share_of_words_with_all_rows(groups):
    marked = sampling.holdout_keys(groups, "w", 0.2, 42).collect()
    words = {r["w"]: r["held"] for r in marked}
    assert sum(words.values()) == math.ceil(0.2 * 101)
    assert all(words[r["w"]] == r["held"] for r in marked) and len(marked) == 3000


def test_first_n_by_key_beyond_the_pruning_limit(spark, groups):
    few = sampling.first_n(groups, 3, ["id"], by=["k"]).collect()
    many = sampling.first_n(groups, 1500, ["id"], by=["k"]).collect()
    by = {}
    for r in groups.collect():
        by.setdefault(r["k"], []).append(r["id"])
    assert {(r["k"], r["id"]) for r in few} == {(k, x) for k, v in by.items() for x in sorted(v)[:3]}
    assert len(many) == 3000


@pytest.mark.parametrize("n", [1001, 1777, 4000, 9000])
def test_first_n_by_bounds_equals_sorting(spark, monkeypatch, n):
    monkeypatch.setattr(sampling, "CELL_KEYS", 50)
    monkeypatch.setattr(sampling, "SAMPLE", 64)
    monkeypatch.setattr(sampling, "STEP", 4)
    rnd = random.Random(n)
    rows = [(rnd.choice(["hot", "hot", "hot", None, "cold"]), rnd.choice([None, *range(7)]), rnd.choice([None, "a", "b", "ä"]), i) for i in range(8000)]
    df = spark.createDataFrame(rows, "k string, x int, y string, i long").repartition(11)
    down = lambda v: (v is None, 0 if v is None else -v)
    up = lambda v: (v is not None, "" if v is None else v)
    want = sorted(rows, key=lambda r: (down(r[1]), up(r[2]), r[3]))
    order = [("x", True), "y", "i"]
    assert [tuple(r) for r in sampling.first_n(df, n, order).collect()] == want[:n]
    per = {}
    for r in want:
        per.setdefault(r[0], []).append(r)
    got = sampling.first_n(df, n, order, by=["k"]).collect()
    assert sorted(r["i"] for r in got) == sorted(r[3] for v in per.values() for r in v[:n])


def test_first_n_with_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CELL_KEYS", 20)
    rows = [("a", 1)] * 700 + [("a", 2)] * 900 + [("b", 2)] * 900 + [("c", i) for i in range(3, 500)]
    df = spark.createDataFrame(rows, "k string, x int")
    got = Counter(tuple(r) for r in sampling.first_n(df, 1500, ["x"]).collect())
    assert got["a", 1] == 700 and sum(got.values()) == 1500 and got["a", 2] + got["b", 2] == 800
    per = Counter(r["k"] for r in sampling.first_n(df, 1200, [("x", True)], by=["k"]).collect())
    assert per == {"a": 1200, "b": 900, "c": 497}
    assert sampling.first_n(df.where("x < 0"), 5000, ["x"]).collect() == []


def test_large_sample_has_no_top_n_in_one_task(spark):
    ids = spark.range(20_000)
    got = [r["id"] for r in sampling.seeded_sample(ids, 15_000, 42, "id").collect()]
    assert len(set(got)) == 15_000
    assert got[:50] == [r["id"] for r in sampling.seeded_sample(ids.repartition(3), 50, 42, "id").collect()]


def test_first_per_key_and_sample(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, p int")
    assert {tuple(r) for r in sampling.first_per_key(df, ["k"], ["p"]).collect()} == {("a", 1), ("b", 3)}
    ids = spark.range(1000)
    a = [r["id"] for r in sampling.seeded_sample(ids, 50, 42, "id").collect()]
    b = [r["id"] for r in sampling.seeded_sample(ids.repartition(9), 50, 42, "id").collect()]
    assert a == b and len(set(a)) == 50 and a != sorted(a)
    assert sampling.seeded_sample(ids, 5000, 42, "id").count() == 1000


def test_split_keeps_null_strata(spark):
    rows = [(i, None if i % 3 == 0 else "a" if i % 3 == 1 else "b") for i in range(90)]
    df = spark.createDataFrame(rows, "id long, s string")
    got = sampling.stratified_split(df, "id", "s", 1).groupBy("s", "split").count().collect()
    assert {(r["s"], r["split"]): r["count"] for r in got} == {(s, k): n for s in (None, "a", "b") for k, n in (("train", 24), ("val", 3), ("test", 3))}
