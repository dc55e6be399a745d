import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexlake.operators.keyed import fits, hot_keys, lookup, ordered_lists, sorted_sets, spread


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one key, some keys unknown, some null."""
    rnd = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{rnd.randint(0, 400)}")) for i in range(9000)]
    return spark.createDataFrame(rows, "i int, k string").cache()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_beyond_the_bound_equals_a_plain_join(spark, skewed, how):
    dim = spark.createDataFrame([(f"k{i}", i) for i in range(0, 300)] + [("hot", None)], "k string, v int")
    plain = skewed.join(dim, ["k"], how)
    assert rows_of(lookup(skewed, dim, ["k"], how, rows=10)) == rows_of(plain)
    assert rows_of(lookup(skewed, dim, ["k"], how)) == rows_of(plain)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_with_several_rows_per_hot_key(spark, skewed, how):
    dim = spark.createDataFrame([(f"k{i % 200}", i) for i in range(400)] + [("hot", 1), ("hot", 2)], "k string, v int")
    assert rows_of(lookup(skewed, dim, ["k"], how, rows=10)) == rows_of(skewed.join(dim, ["k"], how))


def test_hot_rows_spread_over_the_shuffle(spark, skewed):
    """No shuffle partition of the join gets the third of the rows that share a key."""
    dim = spark.createDataFrame([(f"k{i}", i) for i in range(300)] + [("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup(skewed, dim, ["k"], rows=10)
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(r["count"] for r in sizes) < 9000 / 3


def test_hot_keys_are_bounded(skewed):
    assert [r["k"] for r in hot_keys(skewed, ["k"], 0.3).collect()] == ["hot"]
    assert hot_keys(skewed, ["k"], 0.01).count() <= 100


def test_fits(spark):
    assert fits(spark.range(10), 10) and not fits(spark.range(11), 10)


def test_lists_keep_their_order_and_are_whole(spark):
    rnd = random.Random(2)
    rows = [("long", i, f"v{i}") for i in range(20500)] + [(f"k{i % 20}", i, f"v{i}") for i in range(100)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, p long, v string")
    lists = {r["k"]: r["items"] for r in ordered_lists(df, ["k"], "p", F.col("v")).collect()}
    assert lists.pop("long") == [f"v{i}" for i in range(20500)]
    assert lists == {f"k{j}": [f"v{i}" for i in range(100) if i % 20 == j] for j in range(20)}


def test_sets_drop_nulls_and_are_whole(spark):
    rows = [("big", f"t{i % 300}") for i in range(900)] + [("dup", "same")] * 200 + [("a", "y"), ("a", "x"), ("a", None), (None, "z")]
    sets = sorted_sets(spark.createDataFrame(rows, "k string, t string"), ["k"], "t").collect()
    assert {r["k"]: r["items"] for r in sets} == {"big": sorted({f"t{i}" for i in range(300)}), "dup": ["same"], "a": ["x", "y"]}


def test_spread_leaves_large_inputs_alone(spark):
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, 7)).rdd.getNumPartitions() == 7
