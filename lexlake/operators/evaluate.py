"""Prompt grids, metrics by condition, totals and run comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions.match import contain_match, exact_match, same_label, three_way_label, word_match
from lexlake.functions.text import clean_answer, strip
from lexlake.operators.joins import first_existing, join_templates, with_conditions


def render_prompt(
    word: Column, pattern: Column, one_shot: Column, k: Column, s: Column, context: Column
) -> Column:
    """Prompt text: an example block if k, a context line if s, then question and cue."""
    # The wording of the prompt.
    example_head, context_line, question, cue = "Exemple :", '(Contexte : "%s")', "Q : ", "R :"
    has_shot = k & (F.coalesce(one_shot, F.lit("")) != "")
    has_context = s & (F.coalesce(strip(context), F.lit("")) != "")
    return F.concat_ws(
        "\n",
        F.when(has_shot, F.concat(F.lit(example_head + "\n"), one_shot, F.lit("\n"))),
        F.when(has_context, F.format_string(context_line, strip(context))),
        F.concat(F.lit(question), F.replace(pattern, F.lit("<W>"), word)),
        F.lit(cue),
    )


def prompt_grid(df: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """Rows x templates of their key x the four (k, s) conditions."""
    return with_conditions(join_templates(df, templates, key), "k", "s")


def grid_sizes(df: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """Rows the grid will have per key, known without building it."""
    rows = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    per_key = templates.groupBy(key).agg(F.count(F.lit(1)).alias("templates"))
    return rows.join(per_key, key).withColumn("prompts", F.col("rows") * F.col("templates") * 4)


def recompute_metrics(df: DataFrame, targets: str = "targets") -> DataFrame:
    """EM, CM and WM (whole word) on the cleaned answer.

    Unchanged if the table has no targets or no answer column. A whole-word hit
    is also a part of the answer, so CM is the containment test.
    """
    answer = first_existing(df, ["answer", "prediction"])
    if answer is None or targets not in df.columns:
        return df
    cleaned = df.withColumn("_a", clean_answer(F.col(answer)))
    return (
        cleaned.withColumn("EM", exact_match(F.col("_a"), F.col(targets)))
        .withColumn("CM", contain_match(F.col("_a"), F.col(targets)))
        .withColumn("WM", word_match(F.col("_a"), F.col(targets)))
        .drop("_a")
    )


def score_answers(rows: DataFrame, targets: DataFrame, on: list[str], answer: str, target: str = "target") -> DataFrame:
    """``rows`` with EM, CM and WM of ``answer`` against the ``target`` rows of its keys, without a list per key.

    Each distinct answer of a key meets its targets once, and the best of the pairs is taken before the shuffle; rows look their answer up. A
    whole word is also a part, so only pairs that contain each other are looked at for one. A null answer, and keys without
    targets, have null metrics. Null keys have no targets.
    """
    a, t = F.col("a_"), F.col("t_")
    keyed = [F.col(f"`{k}`").alias(f"k{i}_") for i, k in enumerate(on)]
    names = [f"k{i}_" for i in range(len(on))]
    asked = rows.select(*keyed, F.col(f"`{answer}`").alias("a_")).where("a_ IS NOT NULL").distinct()
    wanted = targets.select(*keyed, F.col(f"`{target}`").alias("t_")).where("t_ IS NOT NULL").distinct()
    part = F.contains(a, t)
    word = part & F.regexp_like(a, F.concat(F.lit(r"(?U)\b\Q"), t, F.lit(r"\E\b")))
    best = asked.join(wanted, names).groupBy(*names, "a_").agg(*[F.max(c.cast("int")).alias(n) for n, c in (("EM", a == t), ("CM", part), ("WM", word))])
    same = [rows[f"`{k}`"] == best[f"k{i}_"] for i, k in enumerate(on)] + [rows[f"`{answer}`"] == best["a_"]]
    found = rows.join(best, same, "left")
    return found.select(*[rows[f"`{c}`"] for c in rows.columns], *[best[m] for m in ("EM", "CM", "WM")])


def condition_text(k: Column, s: Column) -> Column:
    bit = lambda c: F.when(c, F.lit("1")).otherwise(F.lit("0"))
    return F.concat(F.lit("k="), bit(k), F.lit(", s="), bit(s))


def metric_means(df: DataFrame, keys: Sequence[str], metrics: Sequence[str] = ("EM", "CM")) -> DataFrame:
    """Mean of each metric per key."""
    return df.groupBy(*keys).agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics])


def metric_grouping_sets(df: DataFrame, key: str, pattern: str) -> DataFrame:
    """Means by condition, by key and condition, by key, and by key and pattern, in one pass."""
    k, s, lf, p = F.col("k"), F.col("s"), F.col(key), F.col(pattern)
    sets = [[k, s], [lf, k, s], [lf], [lf, p]]
    return df.groupingSets(sets, lf, p, k, s).agg(
        F.grouping_id().alias("grouping_no"),
        F.avg("EM").alias("EM_mean"),
        F.avg("CM").alias("CM_mean"),
    )


def total_micro(df: DataFrame, run: str, metric: str) -> DataFrame:
    """Mean over all rows of a run."""
    return df.groupBy(run).agg(F.avg(metric).alias("micro"))


def task_scores(df: DataFrame, run: str, task: str, metric: str) -> DataFrame:
    return df.groupBy(run, task).agg(F.avg(metric).alias("score"))


def total_macro(scores: DataFrame, run: str) -> DataFrame:
    """Unweighted mean of the task scores of a run; 0 for a run without any."""
    return scores.groupBy(run).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("macro"))


def run_completeness(scores: DataFrame, runs: DataFrame, tasks: Sequence[str], run: str, task: str) -> DataFrame:
    """Planned, completed and failed tasks per run; a task without a score has failed."""
    plan = runs.select(run).distinct().withColumn(task, F.explode(F.array(*[F.lit(t) for t in tasks])))
    return (
        plan.join(scores, [run, task], "left")
        .groupBy(run)
        .agg(
            F.count(F.lit(1)).alias("total_tasks"),
            F.count("score").alias("completed_tasks"),
            F.count_if(F.col("score").isNull()).alias("failed_tasks"),
        )
    )


def relabel_three_way(df: DataFrame) -> DataFrame:
    """Expected class from the written verdict, and correctness against it."""
    return df.withColumn("expected", three_way_label(F.col("ground_truth"))).withColumn(
        "is_correct", same_label(F.col("prediction"), F.col("expected"))
    )


def label_accuracy(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of rows whose stripped prediction equals the stripped truth."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(same_label(F.col("prediction"), F.col("ground_truth"))).alias("accuracy"),
    )


def lift_over_base(totals: DataFrame, run: str, family: Column, is_base: Column, value: str) -> DataFrame:
    """Each run against the base run of its family: difference and ratio (null at base 0)."""
    marked = totals.withColumn("family", family)
    base = marked.where(is_base).select("family", F.col(value).alias("base_total"))
    return marked.where(~is_base).join(base, "family").select(
        run,
        "family",
        F.col(value).alias("total"),
        "base_total",
        (F.col(value) - F.col("base_total")).alias("difference"),
        F.try_divide(F.col(value), F.col("base_total")).alias("ratio"),
    )


def merge_scores(
    recorded: DataFrame, computed: DataFrame, keys: Sequence[str], relabelled: DataFrame | None = None
) -> DataFrame:
    """One score per ``keys`` (the run first) with its origin.

    A run with recorded scores has these and no computed ones, also where one is missing; other runs have the computed
    ones. Above both, a ``relabelled`` score replaces the one of its keys, or adds it. Null scores are none.
    """
    run, keys = keys[0], list(keys)
    side = lambda df, origin: df.where("score IS NOT NULL").select(*keys, "score", F.lit(origin).alias("origin"))
    own = side(recorded, "recorded")
    merged = own.unionByName(side(computed, "computed").join(own.select(run).distinct(), run, "left_anti"))
    if relabelled is None:
        return merged
    over = side(relabelled, "relabelled")
    return merged.join(over.select(*keys), keys, "left_anti").unionByName(over)


def token_f1(df: DataFrame, row_id: str, prediction: str, truth: str) -> DataFrame:
    """Bag-of-words F1 and exact match per row.

    Tokens are counted per row and token before the shuffle, so a repeated word
    costs one record. Two empty texts score 1, one empty text scores 0.
    """
    tokens = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    both = df.select(
        F.col(row_id).alias(row_id),
        tokens(F.col(prediction)).alias("_p"),
        tokens(F.col(truth)).alias("_t"),
    )
    word = lambda side: lambda x: F.struct(x.alias("_w"), F.lit(side).alias("_side"))
    tagged = both.select(
        row_id,
        F.inline_outer(F.concat(F.transform("_p", word(1)), F.transform("_t", word(0)))),
    )
    per_word = tagged.groupBy(row_id, "_w").agg(
        F.count_if(F.col("_side") == 1).alias("_a"), F.count_if(F.col("_side") == 0).alias("_b")
    )
    sums = per_word.groupBy(row_id).agg(
        F.sum(F.least("_a", "_b")).alias("common"),
        F.sum("_a").alias("n_pred"),
        F.sum("_b").alias("n_true"),
    )
    precision = F.col("common") / F.col("n_pred")
    recall = F.col("common") / F.col("n_true")
    return sums.select(
        row_id,
        "common",
        "n_pred",
        "n_true",
        F.when((F.col("n_pred") == 0) & (F.col("n_true") == 0), F.lit(1.0))
        .when(F.col("common") == 0, F.lit(0.0))
        .otherwise(2 * precision * recall / (precision + recall))
        .alias("f1"),
    )


def squad_exact(prediction: Column, truth: Column) -> Column:
    """1 if both texts have the same words in the same order."""
    words = lambda c: F.array_join(
        F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), " "
    )
    return (words(prediction) == words(truth)).cast("int")
