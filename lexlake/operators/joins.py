"""Dictionary decoding, self lookup, template and containment joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions.text import strip
from lexlake.operators.keyed import fits, lookup, spread
from lexlake.session import written

MAP_ROWS = 1000  # a dictionary up to this size is looked up inside the row


def decode(df: DataFrame, col: str, dictionary: DataFrame, name: str) -> DataFrame:
    """Replace an id by its name in a (id, name) dictionary; an unknown id gives null."""
    key, label = dictionary.columns[:2]
    dim = dictionary.select(F.col(key).alias(col), F.col(label).alias("_name"))
    return lookup(df, dim, [col]).withColumn(name, F.col("_name")).drop("_name")


def split_code(col: Column) -> Column:
    """``(a,b)`` to an array of ids; null if nothing is inside the brackets."""
    bare = F.btrim(col, F.lit("()"))
    return F.when(bare != "", F.split(bare, ","))


def decode_list(
    df: DataFrame,
    col: str,
    dictionary: DataFrame,
    name: str,
    row_id: Sequence[str],
    rows: int = MAP_ROWS,
) -> DataFrame:
    """Decode a bracketed id list in order; unknown ids stay as they are.

    A short dictionary is a map inside the row. A long one is joined to the
    exploded ids, which ``row_id`` (unique) puts back together.
    """
    key, label = dictionary.columns[:2]
    if fits(dictionary, rows):
        entries = dictionary.select(F.struct(F.col(key).cast("string"), F.col(label)).alias("e"))
        table = entries.agg(F.map_from_entries(F.collect_list("e")).alias("m")).scalar()
        ids = split_code(F.col(col))
        return (
            df.withColumn("_m", table)
            .withColumn(
                name, F.transform(ids, lambda x: F.coalesce(F.try_element_at("_m", x), x))
            )
            .drop("_m")
        )
    single = df.select(*row_id, F.posexplode(split_code(F.col(col))).alias("_p", "_id"))
    named = lookup(single, dictionary.select(F.col(key).cast("string").alias("_id"), F.col(label).alias("_name")), ["_id"])
    packed = named.groupBy(*row_id).agg(
        F.array_sort(
            F.collect_list(F.struct("_p", F.coalesce("_name", "_id").alias("_v")))
        ).alias("_l")
    )
    return (
        df.join(packed, list(row_id), "left")
        .withColumn(name, F.transform("_l", lambda s: s["_v"]))
        .drop("_l")
    )


def last_name_per_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) with the value that comes last in ``order``."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def self_lookup(
    df: DataFrame, ref: str, names: DataFrame, key: str, value: str, order: str, name: str
) -> DataFrame:
    """Replace a reference to another row by that row's name; the last definition wins.

    Only names that are referred to go into the lookup, so that a large table of
    which few rows are targets is still broadcast.
    """
    last = last_name_per_key(names, key, value, order)
    used = df.select(F.col(ref).alias(key)).distinct()
    dim = last.join(used, key, "left_semi").select(F.col(key).alias(ref), F.col(value).alias(name))
    return lookup(df, written(dim, "names"), [ref])


def with_conditions(df: DataFrame, *names: str) -> DataFrame:
    """Repeat each row for every combination of truth values of the named conditions."""
    for name in names:
        df = df.withColumn(name, F.explode(F.array(F.lit(False), F.lit(True))))
    return df


def join_templates(df: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """Rows times the templates of their key; rows without a template drop out."""
    return lookup(df, templates, [key], how="inner")


def skipped_keys(df: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """Keys without a template and the number of rows that drop out for it."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(templates.select(key).distinct(), key, "left_anti")


_RUNS = r"(\p{L}+|\P{L}+)"
_WORDS = r"(\p{L}+)"
_PAIRS = r"(?<!\p{L})(?=(\p{L}+\P{L}+\p{L}+))\p{L}+"  # overlapping
_PAIR, _WORD = 6, 5  # kinds of anchors; 1 to 4 are part lengths


def _all(col: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(1))


def contain_join(
    records: DataFrame, row_id: str, text: str, targets: DataFrame, target_id: str, target: str
) -> DataFrame:
    """(row, target) for every target text that stands inside the row's text.

    Filter and verify, by equality joins only. Each target gives one anchor
    that any text containing it must have, the most selective there is: its
    longest pair of neighbouring words, or its longest word, that have a
    neighbour on both sides and so appear as whole words of the text; or else up
    to four leading characters of its longest run, which appear inside a run of
    the text. Rows sharing an anchor are then checked with ``contains``.
    """
    t = targets.select(
        F.col(target_id).alias("_tid"), F.col(target).alias("_t")
    ).where(F.length("_t") > 0)
    t = t.withColumn("_runs", _all("_t", _RUNS))
    inside = F.array_join(F.slice("_runs", F.lit(2), F.greatest(F.size("_runs") - 2, F.lit(0))), "")
    longest = lambda arr: F.array_max(
        F.transform(arr, lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))
    )["r"]
    pair, word = longest(_all(inside, _PAIRS)), longest(_all(inside, _WORDS))
    part = F.substring(F.coalesce(longest(_all("_t", _WORDS)), longest(F.col("_runs"))), 1, 4)
    kind = F.when(pair.isNotNull(), _PAIR).when(word.isNotNull(), _WORD).otherwise(F.length(part))
    anchors = written(
        t.select("_tid", F.coalesce(pair, word, part).alias("_anchor"), kind.alias("_kind")), "anchors"
    )
    kinds = [r["_kind"] for r in anchors.select("_kind").distinct().collect()]  # six at most
    slim = spread(records.select(F.col(row_id).alias("_rid"), F.col(text).alias("_text")))
    keys = slim.select("_rid", F.lit("").alias("_anchor"), F.lit(0).alias("_kind")).where(F.lit(not kinds))
    for k in kinds:
        whole = {_PAIR: _PAIRS, _WORD: _WORDS}.get(k, _RUNS)
        found = slim.select("_rid", F.explode(F.array_distinct(_all("_text", whole))).alias("_anchor"))
        if k not in (_PAIR, _WORD):
            found = found.select("_rid", F.explode(_grams(F.col("_anchor"), k)).alias("_anchor"))
        found = found.withColumn("_kind", F.lit(k))
        keys = keys.unionByName(found)
    near = lookup(keys, anchors.select("_anchor", "_kind", "_tid"), ["_anchor", "_kind"], how="inner")
    pairs = written(near.select("_rid", "_tid").distinct(), "contain-pairs")
    texts = records.select(F.col(row_id).alias("_rid"), F.col(text).alias("_text"))
    checked = lookup(
        lookup(texts, pairs, ["_rid"], how="inner"), t.select("_tid", "_t"), ["_tid"], how="inner"
    )
    return checked.where(F.contains("_text", "_t")).select(
        F.col("_rid").alias(row_id), F.col("_tid").alias(target_id)
    )


def _grams(word: Column, size: int) -> Column:
    """Distinct parts of ``size`` characters; null for a shorter word."""
    places = F.sequence(F.lit(1), F.length(word) - size + 1)
    parts = F.transform(places, lambda i: F.substring(word, i, F.lit(size)))
    return F.when(F.length(word) >= size, F.array_distinct(parts))


def duplicate_content(df: DataFrame, row_id: str, content: str) -> DataFrame:
    """Rows whose content was seen under a smaller id, with that first id.

    The content is read once, to write (id, hash). The first ids are a partial
    aggregate of that, joined back so that a content copied a billion times is
    spread (see ``lookup``).
    """
    hashed = written(
        df.where(F.col(content).isNotNull()).select(
            F.col(row_id), F.md5(F.col(content)).alias("content_md5")
        ),
        "hashes",
    )
    firsts = (
        hashed.groupBy("content_md5")
        .agg(F.min(row_id).alias("first_id"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select("content_md5", "first_id")
    )
    return lookup(hashed, written(firsts, "firsts"), ["content_md5"], how="inner").where(
        F.col(row_id) > F.col("first_id")
    )


def require_nonempty(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which all the fields have text other than blanks."""
    for c in cols:
        df = df.where(strip(F.col(c)) != "")
    return df


def corpus_filter(df: DataFrame, col: str, min_len: int = 50, max_len: int = 4000) -> DataFrame:
    """Strip, keep texts of at least ``min_len`` characters, then cut at ``max_len``."""
    clean = df.withColumn(col, strip(F.col(col))).where(F.length(col) >= min_len)
    return clean.withColumn(col, F.substring(col, 1, max_len))


def drop_listed(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Drop rows with a listed value; null is not a listed value and stays."""
    return df.where(F.col(col).isNull() | ~F.col(col).isin(list(values)))


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Return ``df`` or raise, naming every column that is missing."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def ensure_column(df: DataFrame, name: str, default: object) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(default))


def first_existing(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of ``names`` that is a column of ``df``."""
    return next((n for n in names if n in df.columns), None)


def explode_struct(df: DataFrame, array: str) -> DataFrame:
    """One row per list element with its fields as columns; an empty list keeps one row."""
    fields = df.schema[array].dataType.elementType.names
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, F.explode_outer(array).alias("_x")).select(
        *rest, *[F.col(f"_x.{f}") for f in fields]
    )


def flatten_relations(df: DataFrame, array: str, relation: str, target: str) -> DataFrame:
    """One row per list element that has both a relation and a target."""
    rest = [c for c in df.columns if c != array]
    flat = df.select(*rest, F.explode(array).alias("_x")).select(*rest, F.col("_x.*"))
    return flat.where((F.col(relation) != "") & (F.col(target) != ""))


def group_key(*cols: str) -> Column:
    """Composite key; null if any part is null."""
    return F.concat(*[p for c in cols for p in (F.lit("||"), F.col(c))][1:])
