"""Candidate pools, candidate ranking, corpus likelihood and caller-given models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.operators import keyed
from lexlake.operators.keyed import fits, lookup, spread
from lexlake.session import written

BLOCK_ROWS = 1000
WIDE_CLASSES = 32  # classes that are summed in columns
LONG_ROWS = 10_000  # tokens with a list of classes that may be broadcast
POOL_BLOCKS = 100  # blocks that may be broadcast: 100,000 candidates
NO_SCORE = -1e9  # fixed value: score of a text without tokens

TOKENS = r"(\p{L}+)"


def tokens_of(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(TOKENS), F.lit(1))


def candidate_pool(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Distinct values per group with the place they were first seen at; nulls dropped."""
    return df.dropna(subset=[group, value]).groupBy(group, value).agg(F.min(order).alias("first_pos"))


def best_candidate(
    rows: DataFrame,
    row_id: str,
    pool: DataFrame,
    group: str,
    candidate: str,
    order: str,
    score: Callable[[Column], Column],
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """The best-scored candidate of each row's group; the earliest on ties, '' without a pool.

    The pool of a group travels in blocks of about ``block`` candidates. A row
    meets each block once and scores it in place, so what is emitted is rows x
    blocks, never rows x candidates. ``score`` gets one candidate as a struct
    column with the pool's fields and may use the columns of ``rows``.
    """
    pool = written(pool, "candidates")
    sizes = pool.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("_blocks"))
    numbered = pool.join(sizes, group).withColumn(
        "_block", F.pmod(F.xxhash64(candidate), F.col("_blocks"))
    )
    fields = [c for c in pool.columns if c != group]
    blocks = written(
        numbered.groupBy(group, "_block").agg(F.collect_list(F.struct(*fields)).alias("_cands")),
        "pool",
    )
    one_each = blocks.where(F.col("_block") > 0).limit(1).count() == 0
    met = lookup(rows, blocks.drop("_block"), [group], rows=POOL_BLOCKS)
    best = F.array_max(
        F.transform(
            "_cands",
            lambda c: F.struct(
                score(c).alias("score"), (-c[order]).alias("o"), c[candidate].alias("candidate")
            ),
        )
    )
    scored = met.select(*rows.columns, best.alias("_best"))
    if not one_each:
        keep = [F.first(c).alias(c) for c in rows.columns if c != row_id]
        scored = scored.groupBy(row_id).agg(*keep, F.max("_best").alias("_best"))
    return scored.select(
        *rows.columns,
        F.coalesce(F.col("_best.candidate").cast("string"), F.lit("")).alias("prediction"),
        F.col("_best.score").alias("score"),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label: averaged per dimension, then one short array."""
    dims = df.select(label, F.posexplode(vector).alias("d", "x"))
    means = dims.groupBy(label, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("l"))
    return packed.select(label, F.transform("l", lambda s: s["m"]).alias("centroid"))


def unigram_model(df: DataFrame, label: str, text: str) -> DataFrame:
    """Token counts per class."""
    words = spread(df.dropna(subset=[label]).select(label, text)).select(label, F.explode(tokens_of(F.col(text))).alias("token"))
    return words.groupBy(label, "token").agg(F.count(F.lit(1)).alias("n"))


def corpus_log_prob(rows: DataFrame, row_id: str, text: str, model: DataFrame, label: str) -> DataFrame:
    """Mean add-one log probability of each row's tokens under every class of ``model``.

    Only (token, class) pairs that exist are joined; a pair that does not is the
    class's constant for unseen tokens, added by token count. A vocabulary that
    can be broadcast is met in the scan, and the sums per row combine there; of a
    larger one, the commonest tokens are (see ``_met``). Gives the
    best class and its score; the smallest label on ties.
    """
    model = written(model, "unigrams")
    vocabulary = model.select("token").distinct().agg(F.count(F.lit(1)).alias("v")).scalar()
    classes = model.groupBy(label).agg(F.sum("n").alias("total")).select(
        F.col(label).alias("label"),
        F.log(F.lit(1.0) / (F.col("total") + vocabulary)).alias("unseen"),
    )
    table = classes.agg(F.array_sort(F.collect_list(F.struct("label", "unseen"))).alias("c")).scalar()
    counted = spread(rows.select(row_id, text)).select(
        row_id, F.explode(tokens_of(F.col(text))).alias("token"), F.lit(1).alias("n")
    )
    labels = [r["label"] for r in classes.select("label").limit(WIDE_CLASSES + 1).collect()]
    sums = (_wide_sums if len(labels) <= WIDE_CLASSES else _long_sums)(counted, row_id, model, label, labels)
    full = (
        rows.join(sums, row_id, "left")
        .withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
        .withColumn("_classes", table)
    )
    mean = lambda c: F.when(
        F.col("n_tokens") > 0,
        c["unseen"] + F.coalesce(F.try_element_at("_gains", c["label"]), F.lit(0.0)) / F.col("n_tokens"),
    ).otherwise(F.lit(NO_SCORE))
    ranked = F.transform(
        "_classes", lambda c, i: F.struct(mean(c).alias("score"), (-i).alias("o"), c["label"].alias("label"))
    )
    best = F.array_max(ranked)
    return full.withColumn("_best", best).select(
        *rows.columns,
        "n_tokens",
        F.col("_best.label").alias("prediction"),
        F.col("_best.score").alias("score"),
    )


def _met(counted: DataFrame, gains: DataFrame, rows: int | None = None) -> DataFrame:
    """``counted`` with the columns of the written ``gains`` (``token``, ``total``, ...), null where there is no such token.

    Gains that are too many to be broadcast are cut by ``total``: as many of the commonest as may be broadcast are met in the scan, where the sums
    per row combine, and only the tokens that are rare in the model are shuffled.
    """
    if fits(gains, rows):
        return counted.join(F.broadcast(gains), "token", "left")
    bound = keyed.BROADCAST_ROWS if rows is None else rows
    # Totals by their number of binary digits: 64 rows at most.
    steps = {r["d"]: r["c"] for r in gains.groupBy(_digits().alias("d")).agg(F.count(F.lit(1)).alias("c")).collect()}
    least, held = max(steps) + 1, 0
    while held + steps.get(least - 1, 0) <= bound:
        least, held = least - 1, held + steps.get(least - 1, 0)
    common = written(gains.where(_digits() >= least), "common")
    rare = written(counted.join(F.broadcast(common.select("token")), "token", "left_anti"), "rare")
    near = counted.join(F.broadcast(common), "token")
    return near.unionByName(lookup(rare, gains.where(_digits() < least), ["token"], rows=rows))


def _digits() -> Column:
    return F.length(F.bin("total"))


def _wide_sums(counted: DataFrame, row_id: str, model: DataFrame, label: str, labels: list) -> DataFrame:
    """Gains of each row per class, a column per class while summing."""
    value = lambda x: F.when(F.col(label) == x, F.log(F.col("n") + 1.0))
    columns = {f"_g{i}": x for i, x in enumerate(labels)}
    gains = written(
        model.groupBy("token").agg(F.sum("n").alias("total"), *[F.max(value(x)).alias(c) for c, x in columns.items()]), "gains"
    )
    sums = _met(counted, gains).groupBy(row_id).agg(
        F.sum("n").alias("n_tokens"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in columns]
    )
    pairs = [p for c, x in columns.items() for p in (F.lit(x), F.col(c))]
    return sums.select(row_id, "n_tokens", F.create_map(*pairs).alias("_gains"))


def _long_sums(counted: DataFrame, row_id: str, model: DataFrame, label: str, labels: list) -> DataFrame:
    """The same for many classes, a row per class while summing."""
    gain = F.struct(F.col(label).alias("label"), F.log(F.col("n") + 1.0).alias("gain"))
    gains = written(model.groupBy("token").agg(F.sum("n").alias("total"), F.collect_list(gain).alias("gains")), "gains")
    # The entry without a label carries the token count of the row.
    size = F.array(F.struct(F.lit(None).alias("label"), F.lit(1.0).alias("gain")))
    parts = _met(counted, gains, LONG_ROWS).select(
        row_id, "n", F.inline(F.concat(size, F.coalesce("gains", F.array())))
    )
    per_class = parts.groupBy(row_id, "label").agg(F.sum(F.col("n") * F.col("gain")).alias("gain"))
    known = F.when(F.col("label").isNotNull(), F.struct("label", "gain"))
    return per_class.groupBy(row_id).agg(
        F.max(F.when(F.col("label").isNull(), F.col("gain"))).cast("long").alias("n_tokens"),
        F.map_from_entries(F.collect_list(known)).alias("_gains"),
    )


def batch_answer(
    df: DataFrame,
    load: Callable[[], Callable[[pd.Series], pd.Series]],
    prompt: str = "prompt",
    answer: str = "answer",
) -> DataFrame:
    """Answer prompts with a caller-given model.

    ``load`` runs once per task and returns a function from a batch of prompts
    to a batch of answers. All other columns pass through.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(answer, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield batch.assign(**{answer: model(batch[prompt])})

    return df.mapInPandas(run, schema)
