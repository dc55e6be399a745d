"""Array expressions on lists, token ids and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED_LABEL = -100  # fixed value: positions a trainer must not learn from


def list_len(col: Column) -> Column:
    """Length of a list, 0 for null."""
    return F.size(F.coalesce(col, F.array())).cast("long")


def zip_padded(**lists: Column) -> Column:
    """Parallel lists to one list of structs; short lists padded with null, null is empty."""
    filled = [F.coalesce(c, F.array()).alias(n) for n, c in lists.items()]
    return F.arrays_zip(*filled)


def best_element(col: Column, field: str) -> Column:
    """Element with the smallest ``field``; the first on ties, a missing value last."""
    ranked = F.transform(
        col,
        lambda x, i: F.struct(
            F.coalesce(x[field].cast("double"), F.lit(float("inf"))).alias("k"),
            i.alias("i"),
            x.alias("x"),
        ),
    )
    return F.array_min(ranked)["x"]


def permute(col: Column, seed: int) -> Column:
    """Order a list by a seeded hash, the same in every run and under any partitioning."""
    keyed = F.transform(
        col, lambda x, i: F.struct(F.md5(F.concat(F.lit(f"{seed}|"), x)).alias("h"), i.alias("i"), x.alias("x"))
    )
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def find_span(ids: Column, target: Column) -> Column:
    """1-based place where ``target`` first occurs in ``ids``; null if nowhere or empty."""
    last = F.size(ids) - F.size(target) + 1
    places = F.when((F.size(target) > 0) & (last >= 1), F.sequence(F.lit(1), last))
    return F.get(F.filter(places, lambda i: F.slice(ids, i, F.size(target)) == target), F.lit(0))


def _in_span(ids: Column, at: Column, size: Column, inside, outside) -> Column:
    hit = lambda i: at.isNotNull() & (i + 1 >= at) & (i + 1 < at + size)
    return F.transform(ids, lambda x, i: F.when(hit(i), inside(x)).otherwise(outside(x)))


def mask_span(ids: Column, at: Column, size: Column, mask_id: int) -> Column:
    """Input ids with the span hidden."""
    return _in_span(ids, at, size, lambda x: F.lit(mask_id), lambda x: x)


def span_labels(ids: Column, at: Column, size: Column) -> Column:
    """Labels that hold the ids of the span and the ignored value elsewhere."""
    return _in_span(ids, at, size, lambda x: x, lambda x: F.lit(IGNORED_LABEL))


def _drawn(key: Column, i: Column, share: float, seed: int) -> Column:
    limit = format(int(share * 2**32), "08x")
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"), F.lit("|"), i.cast("string")))
    return F.substring(digest, 1, 8) < F.lit(limit)


def mask_random(ids: Column, keep: Column, key: Column, share: float, seed: int, mask_id: int) -> Column:
    """Hide each real token (``keep`` = 1) with probability ``share``, by hash of its place."""
    return F.transform(
        ids,
        lambda x, i: F.when(
            (F.get(keep, i) == 1) & _drawn(key, i, share, seed), F.lit(mask_id)
        ).otherwise(x),
    )


def masked_labels(ids: Column, masked: Column, mask_id: int) -> Column:
    """Original ids where they were hidden, the ignored value elsewhere."""
    return F.transform(
        ids,
        lambda x, i: F.when(F.get(masked, i) == mask_id, x).otherwise(F.lit(IGNORED_LABEL)),
    )


def causal_labels(ids: Column, keep: Column) -> Column:
    """Ids as labels, padding ignored."""
    return F.transform(
        ids, lambda x, i: F.when(F.get(keep, i) == 1, x).otherwise(F.lit(IGNORED_LABEL))
    )
