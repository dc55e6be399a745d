"""Mixing sources to target weights: each document is repeated a Poisson number of times drawn from its hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.llm.common import free_name

# Hex digits of a hash that make a uniform number: 52 bits, exact in a double.
DIGITS = 13


def uniform(*parts: Column) -> Column:
    """Number in [0, 1) from the md5 of the parts, joined by ``|``; null parts count as empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long") / F.lit(16.0**DIGITS)


def poisson_steps(rates: DataFrame) -> DataFrame:
    """(source, rate, steps) of (source, rate): the array of P(X <= k) for k = 0, 1, ... as far as a 52-bit uniform number can reach.

    The terms are rows, taken as logarithms so that large rates do not underflow, and summed once per source; there are about as many as the
    rate is large. A rate of 0 has the one step 1, which no number reaches.
    """
    rate = F.col("rate")
    last = F.when(rate > 0, F.ceil(rate + F.sqrt(rate) * 12 + 40)).otherwise(0).cast("int")
    rows = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    k = F.col("k").cast("double")
    in_order = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The logarithm of rate**k / k! is a running sum as well.
    logs = F.sum(F.when(k > 0, F.log(rate) - F.log(k)).otherwise(0.0)).over(in_order)
    terms = rows.withColumn("term", F.when(rate > 0, F.exp(logs - rate)).otherwise(1.0))
    sums = terms.withColumn("upto", F.sum("term").over(in_order))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("k", "upto"))), lambda s: s["upto"])
    return sums.groupBy("source", "rate").agg(listed.alias("steps"))


def steps_upto(steps: Column, number: Column) -> Column:
    """How many of the ascending ``steps`` are at or below ``number``, by halving."""
    size = F.size(steps)
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(size + 1)).cast("int") + 1)

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        below = (acc["low"] < acc["high"]) & (F.get(steps, middle) <= number)
        low = F.when(below, middle + 1).otherwise(acc["low"])
        return F.struct(low.alias("low"), F.when(below, acc["high"]).otherwise(F.greatest(low, middle)).alias("high"))

    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), size.alias("high")), halve, lambda acc: acc["low"])


def source_rates(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", exponent: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, rows, rate): how often a document of a source is expected in the mix.

    With ``weights`` (source, weight), sources get those shares of ``epochs`` times all documents, and a source without a weight
    gets rate 0. Without it, the weight of a source is its number of documents to the power ``exponent`` (1: as it is, 0: all alike).
    """
    rows = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        weighted = rows.withColumn("weight", F.pow(F.col("rows").cast("double"), F.lit(exponent)))
    else:
        given = weights.select(F.col("source").alias("s"), F.col("weight").cast("double").alias("weight"))
        weighted = rows.join(given, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "rows", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    # Both sums are one row each.
    total = weighted.agg(F.sum("rows").alias("r"), F.sum("weight").alias("w"))
    rate = F.col("weight") / F.nullif(total.select("w").scalar(), F.lit(0.0)) * total.select("r").scalar() * epochs / F.col("rows")
    return weighted.select("source", "rows", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    key: str = "doc_id",
    source: str = "source",
    exponent: float = 0.5,
    epochs: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """The columns of ``docs``, and ``copy_no`` (from 1), ``mix_key`` and ``mix_rate``, which must be free names.

    A row comes as often as the inverse of the Poisson distribution with the rate of its source says for
    the number drawn from its id, ``seed`` and a mark; rows of one id are drawn alike. ``mix_key`` is an independent hash of id and copy: tasks
    are dealt by it and sorted by it, so that every output file is a random part of the mix in random order.

    A null source is a source of its own and needs a weight of its own; null ids are drawn as the empty
    string; texts are not looked at. Sources are joined by a small table of their rates, so a source of any size is not
    gathered anywhere. No rows give no rows.
    """
    for name in ("copy_no", "mix_key", "mix_rate"):
        if name in {c.lower() for c in docs.columns}:
            raise ValueError(f"the column {name} is taken")
    rates = source_rates(docs, weights, source, exponent, epochs)
    own, steps, times = (free_name(docs, wanted) for wanted in ("source_", "steps_", "times_"))
    side = poisson_steps(rates.select("source", "rate")).select(F.col("source").alias(own), F.col("rate").alias("mix_rate"), F.col("steps").alias(steps))
    drawn = docs.join(side, F.col(f"`{source}`").eqNullSafe(F.col(own)))
    number = uniform(F.col(f"`{key}`"), F.lit(seed), F.lit("copies"))
    drawn = drawn.withColumn(times, steps_upto(F.col(steps), number))
    copies = drawn.where(F.col(times) > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col(times))))
    place = F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit(str(seed)), F.lit("place"), F.col("copy_no"))), 1, 16)
    keyed = copies.withColumn("mix_key", place).select(*[F.col(f"`{c}`") for c in docs.columns], "copy_no", "mix_key", "mix_rate")
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")
