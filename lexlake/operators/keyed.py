"""Joins and lists by key that stay balanced when one key holds much of the data.

Rules used throughout the library:

* A side is broadcast only when its row count was checked against
  ``BROADCAST_ROWS`` or is bounded by construction (``hot_keys``).
* A plain join of two tables is left to Catalyst, which broadcasts by file
  size, and to adaptive execution, which splits skewed partitions.
* A list is gathered only for keys whose row count is at most ``LIST_ROWS``;
  longer ones come as several consecutive parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.session import written

BROADCAST_ROWS = 500_000
HOT_SHARE = 0.001
SALTS = 97


def fits(df: DataFrame, rows: int | None = None) -> bool:
    """True if ``df`` has at most ``rows`` rows; rows are counted where they are, and one number per task is shuffled."""
    return df.count() <= (BROADCAST_ROWS if rows is None else rows)


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of all rows: never more than 1/share of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    return counts.where(F.col("_n") > F.lit(share) * total.scalar()).select(*keys)


def lookup(
    df: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    rows: int | None = None,
) -> DataFrame:
    """Join ``df`` with ``dim`` on equally named columns; ``how`` is left or inner.

    A small ``dim`` is broadcast. A larger one is shuffled, except for the hot
    keys: their ``dim`` rows are broadcast (bounded, see ``hot_keys``), and their
    rows get a salt that spreads them over the shuffle without matching anything
    there. With several ``dim`` rows per hot key these are repeated per salt.
    """
    on = list(on)
    if fits(dim, rows):
        return df.join(F.broadcast(dim), on, how)
    hot = written(hot_keys(df, on), "hot")
    hot_dim = dim.join(F.broadcast(hot), on, "left_semi")
    if not _over(hot_dim, on, 1).isEmpty():
        return _repeat_join(df, dim, hot, on, how)
    fields = [c for c in dim.columns if c not in on]
    kept = hot_dim.select(*on, F.struct(*fields, F.lit(1).alias("_one")).alias("_side"))
    marked = hot.join(kept, on, "left").select(*on, F.struct("_side").alias("_hot"))
    found = df.join(F.broadcast(marked), on, "left").withColumn("_salt", _salt(F.col("_hot").isNotNull()))
    # Always 0, but not as a literal: Catalyst would take that out of the join keys.
    zero = F.pmod(F.monotonically_increasing_id(), F.lit(1)).cast("int")
    cold = dim.select(*on, zero.alias("_salt"), F.struct(*fields, F.lit(1).alias("_one")).alias("_dim"))
    both = found.join(cold, [*on, "_salt"], "left").withColumn(
        "_dim", F.coalesce(F.col("_hot._side"), F.col("_dim"))
    )
    if how == "inner":
        both = both.where(F.col("_dim._one") == 1)
    rest = [c for c in df.columns if c not in on]
    return both.select(*on, *rest, *[F.col(f"_dim.`{c}`").alias(c) for c in fields])


def _salt(hot: Column) -> Column:
    spread_over = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int") + 1
    return F.when(hot, spread_over).otherwise(F.lit(0))


def _repeat_join(df: DataFrame, dim: DataFrame, hot: DataFrame, on: list[str], how: str) -> DataFrame:
    """Salt the rows of hot keys, and repeat the other side's rows of these keys per salt."""
    flagged = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    left = df.join(flagged, on, "left").withColumn("_salt", _salt(F.col("_hot").isNotNull())).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(1), F.lit(SALTS))).otherwise(F.array(F.lit(0)))
    right = dim.join(flagged, on, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """One partition per core for a table that comes in far fewer splits; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 4 <= cores else df


def ordered_lists(df: DataFrame, keys: Sequence[str], position: str, value: Column, name: str = "items") -> DataFrame:
    """One row per key with all its ``value`` in the order of ``position``, at every size.

    Lists are for results that are lists (node records, chat texts); what is counted or compared should stay in rows.
    """
    packed = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(position).cast("long").alias("_p"), value.alias("_v")))).alias("_l")
    )
    return packed.select(*keys, F.transform("_l", lambda x: x["_v"]).alias(name))


def sorted_sets(df: DataFrame, keys: Sequence[str], value: str, name: str = "items") -> DataFrame:
    """One row per key with its sorted distinct values; null keys and null values are dropped.

    Values are made distinct in each task before they are shuffled.
    """
    base = df.select(*keys, F.col(value).alias("_v")).dropna(subset=[*keys, "_v"])
    return base.groupBy(*keys).agg(F.sort_array(F.collect_set("_v")).alias(name))


def _over(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
