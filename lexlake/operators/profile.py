"""Profiles of columns, lists and keys. Counting always combines before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.operators.keyed import fits, lookup
from lexlake.session import written


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Rows per value, nulls dropped, the most frequent first."""
    counts = df.dropna(subset=list(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), *cols)


def value_shares(df: DataFrame, *cols: str) -> DataFrame:
    """``value_counts`` with the share of all counted rows."""
    counts = df.dropna(subset=list(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, in one pass, most first."""
    sums = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return sums.unpivot([], df.columns, "column_name", "nulls").orderBy(
        F.desc("nulls"), "column_name"
    )


def top_k(counts: DataFrame, k: int, *tie: str) -> DataFrame:
    """The ``k`` most frequent rows of a count table."""
    return counts.orderBy(F.desc("n"), *tie).limit(k)


def top_n_other(df: DataFrame, col: str, n: int, other: str = "Other") -> DataFrame:
    """The ``n`` most frequent values and one row for all the rest."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    top = top_k(counts, n, col)
    kept = F.coalesce(top.agg(F.sum("n").alias("t")).scalar(), F.lit(0))
    rest = counts.agg((F.coalesce(F.sum("n"), F.lit(0)) - kept).alias("n")).select(
        F.lit(other).alias(col), "n"
    )
    return top.unionByName(rest)


def element_counts(df: DataFrame, elements: Column, name: str) -> DataFrame:
    """Rows per list element, nulls dropped."""
    return value_counts(df.select(F.explode(elements).alias(name)), name)


def frequent_keys(df: DataFrame, col: str, at_least: int) -> DataFrame:
    """Values that occur at least so often, with their count."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= at_least)


def combination_counts(
    df: DataFrame, item: str, col: str, at_least: int, top: int | None = None, joiner: str = " + "
) -> DataFrame:
    """The ``top`` most frequent combinations of frequent values per item, or all of them.

    A combination is a sorted multiset, kept as (value, times) pairs: an item
    with a huge number of rows still has at most one pair per frequent value.
    It is written out in full only for the rows of the result.
    """
    keep = written(frequent_keys(df, col, at_least).select(col), "keys")
    pairs = df.where(F.col(item).isNotNull()).groupBy(item, col).agg(F.count(F.lit(1)).alias("times"))
    kept = lookup(pairs, keep, [col], how="inner")
    combos = kept.groupBy(item).agg(
        F.array_sort(F.collect_list(F.struct(F.col(col).alias("v"), "times"))).alias("combo")
    )
    compact = F.array_join(
        F.transform("combo", lambda p: F.concat(p["v"], F.lit("x"), p["times"].cast("string"))), joiner
    )
    # The text only orders ties: unlike combinations may read alike.
    counts = combos.groupBy("combo").agg(F.count(F.lit(1)).alias("n")).withColumn("compact", compact)
    written_out = F.array_join(
        F.flatten(F.transform("combo", lambda p: F.array_repeat(p["v"], p["times"].cast("int")))), joiner
    )
    best = counts if top is None else top_k(counts, top, "compact", "combo")
    return best.select(written_out.alias("combination"), "n")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Rows in equal-width bins over [min, max]; the last bin is closed; empty bins show 0."""
    x = F.col(col).cast("double")
    edges = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("e")).scalar()
    counted = (
        df.where(x.isNotNull())
        .select(x.alias("x"), edges.alias("e"))
        .select("x", F.col("e.lo").alias("lo"), ((F.col("e.hi") - F.col("e.lo")) / bins).alias("w"))
        .select(
            F.when(F.col("w") == 0, F.lit(0))
            .otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")), F.lit(bins - 1)))
            .cast("int")
            .alias("bin")
        )
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = (
        df.sparkSession.range(bins)
        .select(F.col("id").cast("int").alias("bin"), edges.alias("e"))
        .select(
            "bin",
            (F.col("e.lo") + F.col("bin") * (F.col("e.hi") - F.col("e.lo")) / bins).alias("lower"),
            (F.col("e.lo") + (F.col("bin") + 1) * (F.col("e.hi") - F.col("e.lo")) / bins).alias("upper"),
        )
    )
    return frame.join(counted, "bin", "left").select(
        "bin", "lower", "upper", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def length_summary(df: DataFrame, length: Column) -> DataFrame:
    """Count, mean, exact median, largest and smallest of a whole-number length.

    The lengths are counted per value first, so the median sees one row per
    distinct length instead of all rows.
    """
    counts = df.select(length.cast("long").alias("len")).where("len is not null")
    counts = counts.groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
        (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("len", 0.5, F.col("n")).alias("median"),
        F.max("len").alias("max"),
        F.min("len").alias("min"),
    )


def list_size_distribution(df: DataFrame, size: Column) -> DataFrame:
    """Rows per list size, by size."""
    return (
        df.select(size.cast("long").alias("size"))
        .groupBy("size")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("size")
    )


def filter_elements(
    df: DataFrame, array: str, field: str, keys: DataFrame, row_id: Sequence[str], rows: int = 1000
) -> DataFrame:
    """Keep the structs of a list whose ``field`` is in the one-column table ``keys``.

    A null list counts as empty. A short key table is compared inside the row;
    a long one by a join of the exploded elements, put back by ``row_id``.
    """
    key = keys.columns[0]
    keys = written(keys, "keys")
    items = F.coalesce(F.col(array), F.array().cast(df.schema[array].dataType))
    if fits(keys, rows):
        allowed = keys.agg(F.collect_set(key).alias("a")).scalar()
        return df.withColumn("_allowed", allowed).withColumn(
            array, F.filter(items, lambda x: F.array_contains(F.col("_allowed"), x[field]))
        ).drop("_allowed")
    single = df.select(*row_id, F.posexplode(items).alias("_p", "_x")).withColumn(
        key, F.col("_x")[field]
    )
    kept = lookup(single, keys.distinct(), [key], how="inner")
    packed = kept.groupBy(*row_id).agg(
        F.array_sort(F.collect_list(F.struct("_p", "_x"))).alias("_l")
    )
    joined = df.join(packed, list(row_id), "left")
    return joined.withColumn(
        array,
        F.coalesce(
            F.transform("_l", lambda s: s["_x"]), F.array().cast(df.schema[array].dataType)
        ),
    ).drop("_l")


def list_keys(df: DataFrame, array: str, field: str, name: str) -> DataFrame:
    """Values of one field over all list elements, one row each."""
    return df.select(F.explode(array).alias("_x")).select(F.col("_x")[field].alias(name))
