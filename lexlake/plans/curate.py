"""Curate the assembled records into balanced, leak-free splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.functions.arrays import best_element, list_len, permute
from lexlake.functions.text import kwic
from lexlake.operators.joins import drop_listed, flatten_relations, group_key
from lexlake.operators.keyed import sorted_sets
from lexlake.operators.profile import filter_elements, frequent_keys, list_keys
from lexlake.operators.sampling import (
    class_quotas,
    holdout_keys,
    stratified_split,
    stratified_take,
    trim_quotas,
)
from lexlake.session import written

KEYS = ("name", "POS", "lexical_function")


@dataclass
class CurationSettings:
    at_least: int = 100
    budget: int = 12000
    floor: int = 40
    seed: int = 42
    holdout: float = 0.2
    excluded: Sequence[str] = field(default_factory=tuple)


def curated_items(records: DataFrame, order: str, settings: CurationSettings) -> DataFrame:
    """Rows (``order``, name, POS, relation, target) of the frequent relations.

    Records without a frequent relation or without an example drop out.
    """
    found = list_keys(records, "lf_dict", "lexical_function", "lexical_function").where(
        "lexical_function <> ''"
    )
    keep = frequent_keys(found, "lexical_function", settings.at_least).select("lexical_function")
    kept = filter_elements(records, "lf_dict", "lexical_function", keep, [order])
    kept = kept.where((list_len(F.col("lf_dict")) > 0) & (list_len(F.col("examples")) > 0))
    return flatten_relations(kept.select(order, "name", "POS", "lf_dict"), "lf_dict", "lexical_function", "target")


def with_examples(groups: DataFrame, records: DataFrame, order: str) -> DataFrame:
    """The groups with the best example of their record ``order`` in place of that column. Only these records are cut."""
    kept = records.where(list_len(F.col("examples")) > 0).join(groups.select(order).distinct(), order, "left_semi")
    best = best_element(F.col("examples"), "position")
    cut = kept.select(order, "name", "POS", kwic(best["text"], best["occurrence"]).alias("example"))
    # A repeated record gives one example.
    one = cut.groupBy(order, "name", "POS").agg(F.min("example").alias("example"))
    found = groups.join(one, [order, "name", "POS"], "left")
    return found.select(*KEYS, "example", *[c for c in groups.columns if c not in (order, *KEYS)])


def build_groups(items: DataFrame, order: str, settings: CurationSettings) -> DataFrame:
    """One row per (name, POS, relation) with the record first seen; null keys drop out."""
    first = items.dropna(subset=list(KEYS)).groupBy(*KEYS).agg(F.min(order).alias(order))
    return drop_listed(first, "lexical_function", settings.excluded).withColumn(
        "group_id", group_key(*KEYS)
    )


def balanced_groups(groups: DataFrame, settings: CurationSettings) -> DataFrame:
    """A sample of groups under the budget."""
    quotas = class_quotas(groups, "lexical_function", settings.budget, settings.floor)
    trimmed = trim_quotas(quotas, "lexical_function", settings.budget)
    return stratified_take(groups, "lexical_function", "group_id", trimmed, settings.seed)


def split_groups(groups: DataFrame, settings: CurationSettings) -> DataFrame:
    """Label groups unseen (held-out words), train, val or test."""
    marked = holdout_keys(groups, "name", settings.holdout, settings.seed)
    seen = stratified_split(
        marked.where(~F.col("held")).drop("held"), "group_id", "lexical_function", settings.seed
    )
    unseen = marked.where("held").drop("held").withColumn("split", F.lit("unseen"))
    return seen.unionByName(unseen)


def curate(records: DataFrame, order: str, settings: CurationSettings | None = None) -> DataFrame:
    """Records to labelled groups with their permuted target lists.

    Sampling and splitting work on the slim group rows; examples and targets are
    gathered only for the groups that were taken.
    """
    settings = settings or CurationSettings()
    items = written(curated_items(records, order, settings), "items")
    groups = written(build_groups(items, order, settings), "groups")
    taken = written(split_groups(balanced_groups(groups, settings), settings), "taken")
    labelled = written(with_examples(taken, records, order), "labelled")
    wanted = items.join(labelled.select(*KEYS), list(KEYS), "left_semi")
    targets = sorted_sets(wanted, KEYS, "target", "targets")
    return labelled.join(targets, list(KEYS), "left").withColumn(
        "targets", permute(F.col("targets"), settings.seed)
    )
