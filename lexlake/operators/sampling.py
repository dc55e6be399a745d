"""Quotas, seeded samples, holdouts and splits.

Every random choice is an order by ``md5(seed|key)``, so it is the same in
each run, under any partitioning and after a lost executor. Picking the first
r rows of a class in that order needs no per-class window over the rows: the
r-th smallest hash is found from counts per hash prefix (``hash_cuts``), and
the rows are then filtered by comparing with it. A class that holds a third of
all rows is therefore never gathered in one task. The first n rows in any other
order are found alike, from counts between sampled splitters (``first_n``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.operators.keyed import lookup
from lexlake.session import written

PREFIX = 4  # hex digits: 65,536 cells per class
GROUP_LIMIT = 1000  # up to here Spark keeps n rows per task before the shuffle, and a queue of n behind it
CELL_KEYS = 50_000  # distinct sort keys of one group that one task puts in order
SAMPLE, STEP = 1024, 16  # sampled keys per group and round; each STEP-th of them is a splitter


def seeded_hash(seed: int, *cols: str | Column) -> Column:
    """Hex digest that orders rows at random but repeatably."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_cuts(
    rows: DataFrame, keys: Sequence[str], hash_col: Column, ranks: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """For each wanted (key, cut, r) the r-th smallest hash of the key as ``bound``.

    ``ranks`` turns the class sizes (key columns and ``n``) into the wanted
    rows. A rank below 1 gives '' (nothing is at or below it), one beyond the
    class gives 'g', which is above every hex digest. Hashes are unique within
    a key. Without keys there is one class and one cut.

    The input is read once, for its keys and hashes.
    """
    keys = list(keys)
    slim = written(rows.select(*keys, hash_col.alias("_h")), "hashes").withColumn(
        "_cell", F.substring("_h", 1, PREFIX)
    )
    cells = slim.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    sizes = cells.groupBy(*keys).agg(F.sum("_n").alias("n"))
    wanted = ranks(sizes).select(*keys, "cut", F.col("r").cast("long").alias("r"))
    # Bounded window: at most 16**PREFIX cells per key.
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell"))
    cells = cells.withColumn("_upto", upto)
    if keys:
        on = cells.join(wanted, keys)
    else:
        on = cells.select("*", F.lit(0).alias("cut"), wanted.select("r").scalar().alias("r"))
    hit = on.where((F.col("r") <= F.col("_upto")) & (F.col("r") > F.col("_upto") - F.col("_n"))).select(
        *keys, "_cell", "cut", (F.col("r") - F.col("_upto") + F.col("_n")).alias("_left")
    )
    inside = lookup(slim, written(hit, "cut-cells"), [*keys, "_cell"], how="inner")
    # Bounded window: the rows of one cell, about 1/65,536 of a class.
    place = F.row_number().over(Window.partitionBy(*keys, "_cell", "cut").orderBy("_h"))
    bounds = (
        inside.withColumn("_place", place)
        .where(F.col("_place") == F.col("_left"))
        .select(*keys, "cut", F.col("_h").alias("_found"))
    )
    full = wanted.join(bounds, [*keys, "cut"], "left").select(
        *keys,
        "cut",
        F.when(F.col("r") < 1, F.lit("")).otherwise(F.coalesce("_found", F.lit("g"))).alias("bound"),
    )
    return written(full, "cuts")


def class_quotas(df: DataFrame, key: str, budget: int, floor: int) -> DataFrame:
    """Rows to take per class: budget shared by log(1 + size), rounded half to even.

    No class gets less than ``floor``. Gives (key, n, quota).
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum(F.log1p("n")).alias("t")).scalar()
    share = F.log1p("n") / total
    return counts.withColumn(
        "quota", F.greatest(F.rint(share * F.lit(budget)).cast("long"), F.lit(floor).cast("long"))
    )


def trim_quotas(quotas: DataFrame, key: str, budget: int) -> DataFrame:
    """Bring the sum of quotas down to ``budget``, always taking from the largest.

    Taking one from the largest until the sum fits ends with all large quotas
    at a common level, and the ones met last (order: n descending, key) one
    above it. The level follows from running sums over the distinct quota
    values, of which there are at most max(budget, floor) + 1.
    """
    by_value = quotas.groupBy("quota").agg(F.count(F.lit(1)).alias("c"))
    below = Window.orderBy("quota").rowsBetween(Window.unboundedPreceding, -1)
    steps = by_value.select(
        "quota",
        F.coalesce(F.lag("quota").over(Window.orderBy("quota")), F.lit(0)).alias("prev"),
        F.coalesce(F.sum(F.col("quota") * F.col("c")).over(below), F.lit(0)).alias("under"),
        F.sum("c").over(Window.orderBy(F.desc("quota"))).alias("above"),
    )
    # Up to each distinct value the sum of least(quota, level) grows by `above` per level.
    level = F.least(
        F.col("quota"), F.floor((F.lit(budget) - F.col("under")) / F.col("above")).cast("long")
    )
    cut = (
        steps.withColumn("level", level)
        .where((F.col("level") >= F.col("prev")) & (F.lit(budget) >= F.col("under")))
        .agg(
            F.max(
                F.struct("level", (F.col("under") + F.col("level") * F.col("above")).alias("used"))
            ).alias("cut")
        )
    )
    marked = quotas.withColumn("cut", cut.scalar()).select(
        *quotas.columns,
        F.col("cut.level").alias("level"),
        (F.lit(budget) - F.col("cut.used")).alias("spare"),
    )
    over = marked.where(F.col("quota") > F.col("level"))
    # At most `budget` classes can keep one more than the level.
    last = over.orderBy(F.asc("n"), F.desc(key)).limit(budget)
    bonus = (
        last.withColumn("place", F.row_number().over(Window.orderBy(F.asc("n"), F.desc(key))))
        .where(F.col("place") <= F.col("spare"))
        .select(key, F.lit(1).alias("bonus"))
    )
    return marked.join(bonus, key, "left").select(
        key,
        "n",
        (F.least("quota", "level") + F.coalesce("bonus", F.lit(0))).cast("long").alias("quota"),
    )


def stratified_take(
    df: DataFrame, key: str, row_id: str, quotas: DataFrame, seed: int
) -> DataFrame:
    """A seeded sample of min(class size, quota) rows per class; ``row_id`` is unique in a class."""
    wanted = written(quotas.select(key, F.lit(0).alias("cut"), F.col("quota").alias("r")), "quotas")
    h = seeded_hash(seed, row_id)
    cuts = hash_cuts(df, [key], h, lambda sizes: wanted).select(key, "bound")
    return lookup(df, cuts, [key], how="inner").where(h <= F.col("bound")).drop("bound")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key; Spark keeps one row per key and task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", place).where(F.col("_r") == 1).drop("_r")


def _before(a: Sequence[Column], b: Sequence[Column], down: Sequence[bool]) -> Column:
    """True if key ``a`` comes before key ``b``; nulls come first, in descending columns last."""
    out = F.lit(False)
    for x, y, desc in reversed(list(zip(a, b, down, strict=True))):
        null_first, smaller = (y, x > y) if desc else (x, x < y)
        null_side = null_first.isNull() & (x if desc else y).isNotNull()
        out = null_side | F.coalesce(smaller, F.lit(False)) | (x.eqNullSafe(y) & out)
    return out


def _order_cuts(slim: DataFrame, n: int, down: Sequence[bool]) -> DataFrame:
    """For each group (``_k``) of more than ``n`` rows the key (``_o``) of its n-th row, how many rows have that key (``_c``) and how many of them
    are within the first n (``_keep``).

    An interval that holds the n-th key is cut by splitters from a sample of its distinct keys, rows are counted per cell, and the cell with the n-th
    row is the next interval, about a sixtieth of the one before. Equal keys are counted before any shuffle, so ties cost nothing.
    """
    fields = [f"o{i}" for i in range(len(down))]
    part = lambda c: [c.getField(f) for f in fields]
    key = F.col("_o")
    rows, keys = F.count(F.lit(1)).alias("_m"), F.approx_count_distinct(key.getField(fields[-1])).alias("_d")
    sizes = slim.groupBy("_k").agg(rows, keys).where(F.col("_m") > n)
    state = written(sizes.select("_k", "_m", "_d", F.lit(n).cast("long").alias("_left")), "open")
    inside = lookup(slim, state.select("_k"), ["_k"], how="inner")
    turn = 0
    while not (wide := state.where(F.col("_d") > CELL_KEYS)).isEmpty():
        turn += 1
        chance = F.pmod(F.xxhash64(key.getField(fields[-1]), F.lit(turn)), F.lit(1 << 31)) < F.lit(float(SAMPLE << 31)) / F.col("_d")
        sample = lookup(inside, wide.select("_k", "_d"), ["_k"], how="inner").where(chance).select("_k", "_o").distinct()
        # Bounded window: some SAMPLE keys per group.
        place = F.row_number().over(Window.partitionBy("_k").orderBy(*_sorted(part(key), down)))
        splitters = sample.withColumn("_place", place).where(F.col("_place") % STEP == 0)
        listed = F.sort_array(F.collect_list(F.struct("_place", "_o"))).alias("_s")
        cuts = written(splitters.groupBy("_k").agg(listed), "splitters")
        cell = F.size(F.filter("_s", lambda s: ~_before(part(key), part(s["_o"]), down)))
        # Groups without splitters, the narrow ones included, are one cell.
        dealt = lookup(inside, cuts, ["_k"]).withColumn("_cell", F.when(F.col("_s").isNull(), 0).otherwise(cell)).drop("_s")
        counts = dealt.groupBy("_k", "_cell").agg(rows, keys)
        # Bounded window: a cell per splitter.
        upto = F.sum("_m").over(Window.partitionBy("_k").orderBy("_cell"))
        left = F.col("_left") - F.col("_upto") + F.col("_m")
        joined = counts.withColumn("_upto", upto).join(state.select("_k", "_left"), "_k")
        hit = written(joined.where((left > 0) & (F.col("_left") <= F.col("_upto"))).select("_k", "_cell", "_m", "_d", left.alias("_left")), "open")
        inside = written(lookup(dealt, hit.select("_k", "_cell"), ["_k", "_cell"], how="inner").select("_k", "_o"), "inside")
        state = hit.drop("_cell")
    # Bounded window: some CELL_KEYS distinct keys per group.
    upto = F.sum("_c").over(Window.partitionBy("_k").orderBy(*_sorted(part(key), down)))
    ranked = inside.groupBy("_k", "_o").agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", upto).join(state.select("_k", "_left"), "_k")
    keep = F.col("_left") - F.col("_upto") + F.col("_c")
    return written(ranked.where((keep > 0) & (F.col("_left") <= F.col("_upto"))).select("_k", "_o", "_c", keep.alias("_keep")), "order-cuts")


def _sorted(cols: Sequence[Column], down: Sequence[bool]) -> list[Column]:
    return [c.desc() if desc else c.asc() for c, desc in zip(cols, down, strict=True)]


def first_n(
    df: DataFrame, n: int, order: Sequence[str | tuple[str, bool]], by: Sequence[str] | None = None
) -> DataFrame:
    """The first ``n`` rows in ``order``, overall (in that order) or per ``by``; null keys are a group.

    ``order`` has column names, or (name, True) for descending ones. Which of several rows with equal order columns are taken is open, but
    there are exactly n, repeated rows included. Up to ``GROUP_LIMIT`` Spark's own top-n is used. A larger n is
    a bound per group (``_order_cuts``) with which rows are compared where they are, so no task holds n rows; columns then cannot be maps.
    """
    names, down = zip(*[(c, False) if isinstance(c, str) else c for c in order], strict=True)
    sort = _sorted([F.col(f"`{c}`") for c in names], down)
    if n <= GROUP_LIMIT:
        if not by:
            return df.orderBy(*sort).limit(n)
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*sort))
        return df.withColumn("_r", place).where(F.col("_r") <= n).drop("_r")
    own = [F.col(f"`{c}`") for c in df.columns]
    key = [*[F.col(f"`{c}`") for c in names], F.xxhash64(*own)]
    down = [*down, False]
    # A struct is never null, so null keys join as well.
    keyed = df.withColumn("_k", F.struct(*[F.col(f"`{c}`") for c in by]) if by else F.struct(F.lit(0)))
    slim = written(keyed.select("_k", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(key)]).alias("_o")), "order-keys")
    cuts = _order_cuts(slim, n, down)
    bound = [F.col("_o").getField(f"o{i}") for i in range(len(key))]
    same = F.lit(True)
    for x, y in zip(key, bound, strict=True):
        same = same & x.eqNullSafe(y)
    met = lookup(keyed, cuts, ["_k"])
    kept = met.where(F.col("_o").isNull() | _before(key, bound, down) | (same & (F.col("_keep") == F.col("_c")))).select(*own)
    if not cuts.where("_keep < _c").isEmpty():
        # Rows with the key of the n-th are repetitions of one: counted, and given back as often as they are wanted.
        again = met.where(same & (F.col("_keep") < F.col("_c"))).groupBy("_k", *own).agg(F.count(F.lit(1)).alias("_c"), F.first("_keep").alias("_keep"))
        upto = F.sum("_c").over(Window.partitionBy("_k").orderBy(*own))
        times = F.least(F.col("_c"), F.col("_keep") - F.col("_upto") + F.col("_c"))
        again = again.withColumn("_upto", upto).withColumn("_times", times).where("_times > 0")
        kept = kept.unionByName(again.withColumn("_i", F.explode(F.sequence(F.lit(1), "_times"))).select(*own))
    return kept if by else kept.orderBy(*sort)


def seeded_sample(df: DataFrame, n: int, seed: int, row_id: str) -> DataFrame:
    """``n`` rows in seeded random order; all of them if there are fewer. ``row_id`` is unique."""
    return first_n(df.withColumn("_h", seeded_hash(seed, row_id)), n, ["_h", row_id]).drop("_h")


def holdout_keys(df: DataFrame, key: str, share: float, seed: int, name: str = "held") -> DataFrame:
    """Mark the rows of a seeded ``share`` of the distinct keys, a fraction rounded up.

    The rows are compared with one hash bound, so neither a join nor a shuffle
    of the rows is needed.
    """
    h = seeded_hash(seed, key)
    keys = df.where(F.col(key).isNotNull()).select(key).distinct()
    part = lambda sizes: sizes.select(
        F.lit(0).alias("cut"), F.ceil(F.col("n") * F.lit(share)).alias("r")
    )
    bound = hash_cuts(keys, [], h, part).select("bound").scalar()
    return df.withColumn(name, F.coalesce(h <= bound, F.lit(False)))


def apportion(sizes: DataFrame, key: str, n: str, draws: int, tie: Column, name: str) -> DataFrame:
    """Share ``draws`` out over the rows of ``sizes`` (one for each ``key``, none null) in proportion to ``n``, as the whole-numbered column ``name``.

    Each gets the whole part of its share; what is left goes, one each, to the largest remainders, equal ones in the order
    of ``tie``. The sum is ``draws`` exactly. Shares are exact decimals, and the largest are found by ``first_n``.
    """
    total = sizes.agg(F.sum(n)).first()[0]
    if not total:
        return sizes.withColumn(name, F.lit(0).cast("long"))
    share = F.col(n).cast("decimal(19,0)") * F.lit(draws).cast("decimal(19,0)")
    whole = F.lit(total).cast("decimal(19,0)")
    rest = share % whole
    parts = written(sizes.withColumns({"_rest": rest, name: ((share - rest) / whole).cast("long")}), "shares")
    left = draws - parts.agg(F.sum(name)).first()[0]
    more = first_n(parts.select(key, "_rest", tie.alias("_tie")), left, [("_rest", True), "_tie"])
    # One row per key on both sides, so no key is hot.
    bonus = parts.drop("_rest").join(written(more.select(key, F.lit(1).alias("_more")), "more"), key, "left")
    return bonus.withColumn(name, F.col(name) + F.coalesce("_more", F.lit(0))).drop("_more")


def stratified_split(
    df: DataFrame,
    row_id: str,
    stratum: str,
    seed: int,
    train: float = 0.8,
    val: float = 0.5,
    name: str = "split",
) -> DataFrame:
    """Label rows train, val or test, with exact sizes overall and shares of every stratum within one id of them; a null stratum is one of its own.

    The rest beyond ``train`` is a fraction of all ids rounded up, ``val`` the share of that rest, of which test is
    rounded up. Strata take part by largest remainders (``apportion``). One id gives one label, so rows of a group never part.
    """
    h = seeded_hash(seed, row_id)
    key = "_stratum"  # a struct is never null, so null strata join as well
    ids = df.select(F.struct(stratum).alias(key), row_id).distinct()

    def ranks(sizes: DataFrame) -> DataFrame:
        counted = written(sizes, "sizes")
        total = counted.agg(F.sum("n")).first()[0] or 0
        rest = math.ceil(total * (1 - train))
        tie = seeded_hash(seed, F.col(key)[stratum])
        heads = written(apportion(counted, key, "n", total - rest, tie, "_head"), "heads").withColumn("_other", F.col("n") - F.col("_head"))
        mids = apportion(heads, key, "_other", rest - math.ceil(rest * (1 - val)), tie, "_mid")
        two_cuts = F.array(
            F.struct(F.lit(0).alias("cut"), F.col("_head").alias("r")),
            F.struct(F.lit(1).alias("cut"), (F.col("_head") + F.col("_mid")).alias("r")),
        )
        return mids.select(key, F.inline(two_cuts))

    cuts = (
        hash_cuts(ids, [key], h, ranks)
        .groupBy(key)
        .agg(
            F.max(F.when(F.col("cut") == 0, F.col("bound"))).alias("_b0"),
            F.max(F.when(F.col("cut") == 1, F.col("bound"))).alias("_b1"),
        )
    )
    label = (
        F.when(h <= F.col("_b0"), F.lit("train"))
        .when(h <= F.col("_b1"), F.lit("val"))
        .otherwise(F.lit("test"))
    )
    keyed = df.withColumn(key, F.struct(stratum))
    return lookup(keyed, cuts, [key], how="inner").withColumn(name, label).drop("_b0", "_b1", key)


def split_overlap(df: DataFrame, row_id: str, split: str = "split") -> DataFrame:
    """Number of ids that two splits share, one row per pair of splits."""
    flags = [F.max(F.when(F.col(split) == s, 1).otherwise(0)).alias(s) for s in ("train", "val", "test")]
    per_id = df.groupBy(row_id).agg(*flags)
    pairs = (("train", "val"), ("train", "test"), ("val", "test"))
    counts = per_id.agg(
        *[F.sum((F.col(a) * F.col(b)).cast("long")).alias(f"{a}-{b}") for a, b in pairs]
    )
    return counts.unpivot([], [f"{a}-{b}" for a, b in pairs], "pair", "shared")


def split_profile(df: DataFrame, stratum: str, split: str = "split") -> DataFrame:
    """Rows per split and class with the share within the split."""
    counts = df.groupBy(split, stratum).agg(F.count(F.lit(1)).alias("n"))
    # Bounded window: one row per class.
    total = F.sum("n").over(Window.partitionBy(split))
    return counts.withColumn("share", F.col("n") / total)
