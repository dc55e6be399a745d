import math
from collections import Counter

import pytest
from helpers import clashing, no_docs, odd_docs
from pyspark.sql import functions as F

from lexlake.llm import mixing


@pytest.mark.parametrize("rate", [0.0, 0.3, 4.0, 900.0])
def test_steps_are_the_distribution(spark, rate):
    rates = spark.createDataFrame([("a", rate), (None, rate)], "source string, rate double")
    both = {r["source"]: r["steps"] for r in mixing.poisson_steps(rates).collect()}
    assert both["a"] == both[None]
    steps = both["a"]
    if not rate:
        assert steps == [1.0]
        return
    want, total = [], 0.0
    for k in range(len(steps)):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        want.append(total)
    assert steps == pytest.approx(want, abs=1e-9) and steps[-1] > 1 - 1e-12


def test_copies_are_the_steps_at_or_below_a_number(spark):
    steps = [0.1, 0.1, 0.25, 0.5, 1.0]
    numbers = [0.0, 0.05, 0.1, 0.2, 0.25, 0.4, 0.5, 0.99, 1.0]
    rows = spark.createDataFrame([(u,) for u in numbers], "u double").select("u", mixing.steps_upto(F.array(*[F.lit(s) for s in steps]), F.col("u")).alias("n"))
    assert {r["u"]: r["n"] for r in rows.collect()} == {u: sum(s <= u for s in steps) for u in numbers}


def test_a_rare_source_with_a_large_weight(spark):
    docs = spark.range(30000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "rare").otherwise("big").alias("source"))
    weights = spark.createDataFrame([("big", 1.0), ("rare", 9.0)], "source string, weight double")
    n = {r["source"]: r["count"] for r in mixing.mix(docs, weights).groupBy("source").count().collect()}
    assert abs(n["rare"] - 27000) < 1000 and abs(n["big"] - 3000) < 300


def test_shares_follow_weights(spark):
    docs = spark.range(40000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 < 9, "big").otherwise("small").alias("source")
    )
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "source string, weight double")
    rows = mixing.mix(docs, weights).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in rows}
    assert abs(n["big"] - 10000) < 500 and abs(n["small"] - 30000) < 900
    copies = Counter(r["copy_no"] for r in mixing.mix(docs, weights).where("source = 'small'").select("copy_no").collect())
    assert abs(copies[1] - 4000 * (1 - math.exp(-7.5))) < 60


def test_order_is_shuffled_and_repeatable(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    first = [(r["doc_id"], r["copy_no"]) for r in mixing.mix(docs).collect()]
    again = [(r["doc_id"], r["copy_no"]) for r in mixing.mix(docs.repartition(3)).collect()]
    assert sorted(first) == sorted(again) and [i for i, _ in first] != sorted(i for i, _ in first)
    assert sorted(first) != sorted((r["doc_id"], r["copy_no"]) for r in mixing.mix(docs, seed=1).collect())


def test_odd_rows_and_plan(spark):
    docs = clashing(odd_docs(spark))
    for name in ("source_", "steps_", "times_", "__n", "__u", "rate", "upto"):
        docs = docs.withColumn(name, F.lit("taken"))
    out = mixing.mix(docs, epochs=5.0)
    assert out.columns == [*docs.columns, "copy_no", "mix_key", "mix_rate"]
    rows = out.collect()
    assert any(r["source"] is None for r in rows) and {r[c] for r in rows for c in ("k", "steps_", "times_", "__n", "source_")} == {"taken"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    assert mixing.mix(no_docs(spark)).count() == 0
    with pytest.raises(ValueError, match="taken"):
        mixing.mix(docs.withColumnRenamed("lang", "Copy_No"))
