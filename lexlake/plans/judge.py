"""Judge answers: grid, answers, metrics and the report table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.functions.text import clean_answer, first_answer
from lexlake.operators.evaluate import prompt_grid, recompute_metrics, render_prompt, score_answers
from lexlake.operators.report import markdown_rows, score_matrix
from lexlake.operators.scoring import batch_answer
from lexlake.session import written


def prompts(items: DataFrame, templates: DataFrame) -> DataFrame:
    """Every prompt of the benchmark: items x templates x conditions."""
    grid = prompt_grid(items, templates, "lexical_function")
    return grid.withColumn(
        "prompt",
        render_prompt(
            F.col("name"), F.col("pattern"), F.col("one_shot"), F.col("k"), F.col("s"), F.col("example")
        ),
    )


def judged(
    items: DataFrame,
    templates: DataFrame,
    load: Callable[[], Callable[[pd.Series], pd.Series]],
    run: str,
    targets: DataFrame | None = None,
    key: str = "group_id",
) -> DataFrame:
    """Answers of one model with EM, CM and WM. Lower-case targets are rows (``key``, ``target``), or lists ``targets`` of ``items``."""
    raw = batch_answer(prompts(items, templates), load)
    answered = raw.withColumn("answer", first_answer(F.col("answer")))
    if targets is None:
        return recompute_metrics(answered).withColumn("model", F.lit(run))
    # Written: the model is asked once, the answers are read twice.
    cleaned = written(answered.withColumn("cleaned", clean_answer(F.col("answer"))), "answers")
    return score_answers(cleaned, targets, [key], "cleaned").drop("cleaned").withColumn("model", F.lit(run))


def report(results: DataFrame, runs: Sequence[str], metric: str = "CM") -> DataFrame:
    """Markdown lines of relation x model means with the mean over all rows at the end."""
    scores = results.select("model", "lexical_function", F.col(metric).alias("score"))
    matrix = score_matrix(scores, "lexical_function", "model", runs)
    total = scores.groupBy().pivot("model", list(runs)).agg(F.avg("score"))
    return markdown_rows(matrix, "lexical_function", runs, total, digits=1, missing="0.0%", key_title="Relation")
