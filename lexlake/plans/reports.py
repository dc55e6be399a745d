"""Reports from run files: scores by precedence, models by total, Markdown lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexlake.functions.match import same_label, three_way_label
from lexlake.functions.text import clean_run_name, list_text, parse_list
from lexlake.operators.evaluate import merge_scores, recompute_metrics, task_scores
from lexlake.operators.keyed import lookup
from lexlake.operators.report import markdown_rows, score_matrix, scores_long
from lexlake.session import written


def result_rows(results: DataFrame, run: str = "model") -> DataFrame:
    """Judged answers as result records: one row per prompt and answer, targets as list text, with the ``run`` they belong to.

    Written by ``files.write_results`` and read by ``files.read_runs``, they are what ``relation_report`` takes.
    """
    # Columns of a result record.
    flag = lambda c: F.when(F.col(c), F.lit("True")).otherwise(F.lit("False")).alias(c)
    return results.select(
        F.col("name").alias("word"), F.col("pos"), F.col("lexical_function").alias("lexical_functions"), "pattern",
        list_text(F.col("targets")).alias("targets"), flag("k"), flag("s"), "prompt", "answer", "EM", "CM", F.col(run).alias("run"),
    )


def relabelled_scores(rows: DataFrame, task: str) -> DataFrame:
    """(run, task_name, score) of ``task`` with correctness taken anew from the written verdicts; only runs where a recorded mark differs."""
    new = same_label(F.col("prediction"), three_way_label(F.col("ground_truth")))
    judged = rows.where(F.col("task_name") == task).select("run", "task_name", "is_correct", new.alias("new"))
    changed = F.max(~F.col("is_correct").eqNullSafe(F.col("new")))
    return judged.groupBy("run", "task_name").agg(F.avg("new").alias("score"), changed.alias("changed")).where("changed").drop("changed")


def run_scores(summaries: DataFrame, rows: DataFrame, task: str) -> tuple[DataFrame, DataFrame]:
    """(run, task_name, score, origin) and (run, total) of all runs with a summary or with marked rows.

    A summary stands for its whole run, else task means of the rows do; the relabelled ``task`` replaces either. A recorded total
    holds unless the run was relabelled (0 if it is missing); other totals are means of the task scores.
    """
    rows = rows.where("task_name IS NOT NULL")
    relabelled = written(relabelled_scores(rows, task), "relabelled")
    # A run with no summary and no marks at all is none.
    computed = written(task_scores(rows, "run", "task_name", "is_correct").where("score IS NOT NULL"), "computed")
    known = computed.select("run").union(summaries.select("run")).distinct()
    relabelled = relabelled.join(known, "run", "left_semi")
    # A summary without scores still hides computed ones.
    free = computed.join(summaries.select("run"), "run", "left_anti")
    scores = written(merge_scores(scores_long(summaries, "run"), free, ["run", "task_name"], relabelled), "scores")
    means = scores.groupBy("run").agg(F.avg("score").alias("mean"), F.max(F.col("origin") == "relabelled").alias("anew"))
    recorded = summaries.groupBy("run").agg(F.max("cole_score").alias("recorded"), F.lit(True).alias("has"))
    both = known.join(means, "run", "left").join(recorded, "run", "left")
    keep = F.col("has") & ~F.coalesce("anew", F.lit(False))
    return scores, both.select("run", F.when(keep, F.col("recorded")).otherwise(F.col("mean")).alias("total")).fillna(0.0, ["total"])


def ranked_models(totals: DataFrame, first: str) -> list[str]:
    """Models of (``model``, ``total``), best first, equal ones in order of ``first``: as many as the report has columns."""
    return [r["model"] for r in totals.orderBy(F.desc("total"), first).select("model").collect()]


def task_report(
    summaries: DataFrame, rows: DataFrame, task: str, suffix: str, key_title: str = "Task", total_title: str = "TOTAL"
) -> DataFrame:
    """Markdown lines (section, sort_key, line) of task x model scores with the totals at the end, models by total.

    ``summaries`` are ``read_summaries``, ``rows`` are ``read_runs`` with task_name, prediction, ground_truth and is_correct; a run may have either or
    both. Scores are those of ``run_scores``. A model is named by its summary, else by the run without ``suffix`` and time
    stamp; of several runs of one name the last by run name counts per task.
    """
    summaries = written(summaries.select("run", "model_name", "cole_score", "task_scores"), "summaries")
    scores, totals = run_scores(summaries, rows, task)
    named = summaries.groupBy("run").agg(F.coalesce(F.max("model_name"), "run").alias("model"))
    names = totals.join(named, "run", "left").withColumn("model", F.coalesce("model", clean_run_name(F.col("run"), suffix)))
    names = written(names, "names")
    cells = scores.join(names.select("run", "model"), "run").groupBy("task_name", "model").agg(F.max_by("score", "run").alias("score"))
    per_model = written(names.groupBy("model").agg(F.max_by("total", "run").alias("total"), F.min("run").alias("first")), "totals")
    models = ranked_models(per_model, "first")
    total = per_model.groupBy().pivot("model", models).agg(F.first("total"))
    matrix = score_matrix(cells, "task_name", "model", models)
    return markdown_rows(matrix, "task_name", models, total, digits=2, key_title=key_title, total_title=total_title)


def recomputed_runs(rows: DataFrame) -> DataFrame:
    """(run, lexical_functions, EM, CM) of result rows (run, lexical_functions, targets, answer, prediction, EM, CM).

    Runs with targets and answers are matched anew; a row of theirs without targets matches nothing. Other runs keep their marks, 0
    throughout if they have none. Which runs have what is one row per run, looked up.
    """
    answer = F.coalesce("answer", "prediction")
    has = rows.groupBy("run").agg(
        (F.max(F.col("targets").isNotNull()) & F.max(answer.isNotNull())).alias("_anew"),
        *[F.max(F.col(m).isNotNull()).alias(f"_has_{m}") for m in ("EM", "CM")],
    )
    own = rows.select("run", "lexical_functions", parse_list(F.col("targets")).alias("targets"), answer.alias("answer"), *[F.col(m).alias(f"_{m}") for m in ("EM", "CM")])
    met = lookup(recompute_metrics(own), written(has, "runs"), ["run"])
    mark = lambda m: F.when(F.col("_anew"), F.coalesce(m, F.lit(0))).when(F.col(f"_has_{m}"), F.col(f"_{m}")).otherwise(F.lit(0))
    return met.select("run", "lexical_functions", *[mark(m).alias(m) for m in ("EM", "CM")])


def relation_report(rows: DataFrame, metric: str = "CM", key_title: str = "Relation", total_title: str = "TOTAL") -> DataFrame:
    """Markdown lines of relation x run means of ``metric`` with the mean over all rows at the end, runs by that mean.

    ``rows`` as for ``recomputed_runs``. Rows without a relation count in the total only.
    """
    marks = recomputed_runs(rows)
    # One pass over the rows: sums per run and relation, totals from these.
    sums = marks.groupBy("run", "lexical_functions").agg(F.sum(metric).alias("s"), F.count(metric).alias("c"))
    sums = written(sums, "sums")
    totals = written(sums.groupBy(F.col("run").alias("model")).agg((F.sum("s") / F.sum("c")).alias("total")), "totals")
    models = ranked_models(totals, "model")
    cells = sums.where("lexical_functions IS NOT NULL").select("lexical_functions", "run", (F.col("s") / F.col("c")).alias("score"))
    matrix = score_matrix(cells, "lexical_functions", "run", models)
    total = totals.groupBy().pivot("model", models).agg(F.first("total"))
    return markdown_rows(matrix, "lexical_functions", models, total, digits=1, missing="0.0%", key_title=key_title, total_title=total_title)


def numbered(lines: DataFrame) -> DataFrame:
    """(line_no, line) of report lines in their order. A report has a row per task, so one small sort."""
    order = Window.orderBy("section", "sort_key")
    return lines.select(F.row_number().over(order).cast("long").alias("line_no"), "line")
