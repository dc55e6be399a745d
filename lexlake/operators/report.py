"""Score tables: maps, pivots, rankings, header matching and Markdown rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.functions.text import parse_percent, percent_text, strip


def score_maps(scores: DataFrame, run: str, task: str) -> DataFrame:
    """One row per run with the map task -> score (bounded by the number of tasks)."""
    entry = F.struct(F.col(task), F.col("score"))
    return scores.groupBy(run).agg(F.map_from_entries(F.collect_list(entry)).alias("task_scores"))


def scores_long(summaries: DataFrame, run: str = "model_name", scores: str = "task_scores") -> DataFrame:
    """Run summaries with a score map to (run, task, score) rows."""
    return summaries.select(run, F.explode(scores).alias("task_name", "score"))


def order_models(totals: DataFrame, run: str, value: str) -> DataFrame:
    """Runs by total, best first, with their place. One row per run, so one small sort."""
    order = Window.orderBy(F.desc(value), F.col(run))
    return totals.withColumn("place", F.row_number().over(order))


def run_names(scores: DataFrame, run: str) -> list[str]:
    """The runs of a score table, shorter names first: as many as the report has columns."""
    return [r[run] for r in scores.where(F.col(run).isNotNull()).select(run).distinct().orderBy(F.length(run), run).collect()]


def score_matrix(scores: DataFrame, task: str, run: str, runs: Sequence[str]) -> DataFrame:
    """Tasks x runs; a missing combination is null. The runs are named, so no extra job."""
    return scores.groupBy(task).pivot(run, list(runs)).agg(F.avg("score"))


def markdown_rows(
    matrix: DataFrame,
    key: str,
    runs: Sequence[str],
    totals: DataFrame | None = None,
    digits: int = 2,
    missing: str = "-",
    key_title: str = "Task",
    total_title: str = "TOTAL",
) -> DataFrame:
    """Lines of a Markdown table: header, ruler, one row per key, a total row.

    ``totals`` is one row with a column per run.
    """
    spark = matrix.sparkSession
    line = lambda first, cells: F.concat(
        F.lit("| "), first, F.lit(" | "), F.concat_ws(" | ", *cells), F.lit(" |")
    )
    frame = spark.range(2).select(
        F.col("id").cast("int").alias("section"),
        F.lit("").alias("sort_key"),
        F.when(F.col("id") == 0, line(F.lit(key_title), [F.lit(r) for r in runs]))
        .otherwise(line(F.lit(":---"), [F.lit(":---:") for _ in runs]))
        .alias("line"),
    )
    bold = lambda c: F.concat(F.lit("**"), c, F.lit("**"))
    cells = [percent_text(F.col(f"`{r}`"), digits, missing) for r in runs]
    body = matrix.select(
        F.lit(2).alias("section"), F.col(key).alias("sort_key"), line(bold(F.col(key)), cells).alias("line")
    )
    out = frame.unionByName(body)
    if totals is not None:
        cells = [bold(percent_text(F.coalesce(F.col(f"`{r}`"), F.lit(0.0)), digits)) for r in runs]
        out = out.unionByName(
            totals.select(
                F.lit(3).alias("section"), F.lit("").alias("sort_key"), line(bold(F.lit(total_title)), cells).alias("line")
            )
        )
    return out


def match_headers(headers: Column, wanted: Column) -> Column:
    """The first header that contains the wanted name or is contained in it; null if none."""
    return F.get(
        F.filter(headers, lambda h: F.contains(h, wanted) | F.contains(wanted, h)), F.lit(0)
    )


def heat_cells(cells: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """(row, wanted name, number) from parsed Markdown cells; an unmatched name gives 0.0.

    ``cells`` has ``row_no``, ``headers`` (the header line's cells) and ``cells``.
    The wanted names are one per column of the drawn matrix, so few; they ride
    along as one array instead of a cross join.
    """
    names = wanted.agg(F.collect_list(name).alias("w")).scalar()
    wide = cells.withColumn("_w", names).select("row_no", "headers", "cells", F.explode("_w").alias(name))
    at = F.array_position("headers", match_headers(F.col("headers"), F.col(name))).cast("int")
    cell = F.when(at > 0, F.try_element_at("cells", at))
    return wide.select(
        "row_no",
        F.replace(F.get("cells", F.lit(0)), F.lit("**"), F.lit("")).alias("row_name"),
        name,
        F.coalesce(parse_percent(strip(cell)), F.lit(0.0)).alias("value"),
    )
