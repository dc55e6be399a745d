"""Report tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.catalog.base import Tables, query, with_views
from lexlake.functions import text
from lexlake.operators import evaluate, profile, report
from lexlake.plans import reports
from lexlake.session import scratch_path
from lexlake.sources import files, markup

NAMES_SQL = """with names as (select doc_id, case doc_id % 3 when 0 then concat(source, '_task_results_20260410_091638')
  when 1 then concat(source, '_task_results') else concat('my_', source, '_base') end as stem from documents),
bare as (select doc_id, replace(stem, '_task_results', '') as b from names)
select doc_id, case when len(string_split(b, '_')) >= 2 and regexp_matches(string_split(b, '_')[-2], '^[0-9]+$')
  then array_to_string(string_split(b, '_')[1:-3], '_') else b end as model from bare"""


@query("clean_run_name", NAMES_SQL)
def clean_run_name(t: Tables) -> DataFrame:
    k, source = F.col("doc_id") % 3, F.col("source")
    stem = (
        F.when(k == 0, F.concat(source, F.lit("_task_results_20260410_091638")))
        .when(k == 1, F.concat(source, F.lit("_task_results")))
        .otherwise(F.concat(F.lit("my_"), source, F.lit("_base")))
    )
    return t.documents.select("doc_id", text.clean_run_name(stem, "_task_results").alias("model"))


@query(
    "percent_text",
    with_views("v_eval")
    + "select model, task_name, printf('%.2f%%', round_even(avg(is_correct) * 100, 2)) as percent from v_eval group by all",
)
def percent_text(t: Tables) -> DataFrame:
    scores = evaluate.task_scores(t.v_eval, "model", "task_name", "is_correct")
    return scores.select("model", "task_name", text.percent_text(F.col("score"), 2).alias("percent"))


@query(
    "parse_percent",
    "select doc_id, case when doc_id % 5 = 0 then 0.0 else (n_chars % 1000) / 10 end::double as value from documents",
)
def parse_percent(t: Tables) -> DataFrame:
    number = ((F.col("n_chars") % 1000) / 10).cast("string")
    cell = F.when(F.col("doc_id") % 5 == 0, F.lit("-")).otherwise(F.concat(F.lit("**"), number, F.lit("%**")))
    return t.documents.select("doc_id", text.parse_percent(cell).alias("value"))


@query(
    "match_headers",
    """with h as (select source, row_number() over (order by source desc) as i from (select distinct source from documents))
select w.source as wanted, (select min_by(h.source, h.i) from h where contains(h.source, w.source) or contains(w.source, h.source)) as header
from (select distinct source from documents) w""",
)
def match_headers(t: Tables) -> DataFrame:
    names = t.documents.select("source").distinct()
    headers = names.agg(F.sort_array(F.collect_list("source"), asc=False).alias("h")).scalar()
    return names.withColumn("h", headers).select(
        F.col("source").alias("wanted"), report.match_headers(F.col("h"), F.col("source")).alias("header")
    )


@query(
    "heat_matrix",
    with_views("v_eval")
    + """, scores as (select task_name, model, avg(is_correct) as score from v_eval group by all)
, names as (select distinct model from v_eval)
, heads as (select w.model, min_by(h.model, lpad(cast(length(h.model) as varchar), 6, '0') || h.model) as head from names w join names h
  on contains(h.model, w.model) or contains(w.model, h.model) group by w.model)
select t.task_name as row_name, m.model as wanted, coalesce(round_even(s.score * 100, 2), 0.0) as value
from (select distinct task_name from v_eval) t cross join heads m
left join scores s on s.task_name = t.task_name and s.model = m.head""",
)
def heat_matrix(t: Tables) -> DataFrame:
    """Report written as Markdown, read back, matched to the wanted names, as numbers."""
    rows = t.v_eval
    scores = evaluate.task_scores(rows, "model", "task_name", "is_correct")
    path = scratch_path(t.spark, "heat")
    models = report.run_names(scores, "model")
    markup.write_markdown(
        report.markdown_rows(report.score_matrix(scores, "task_name", "model", models), "task_name", models), path
    )
    wanted = rows.select(F.col("model").alias("wanted")).distinct()
    cells = report.heat_cells(markup.read_markdown_table(t.spark, path), wanted, "wanted")
    return cells.select("row_name", "wanted", "value")


@query(
    "score_matrix",
    with_views("v_eval")
    + ", scores as (select task_name, model, round(avg(is_correct), 6) as score from v_eval group by all) pivot scores on model using first(score) group by task_name",
)
def score_matrix(t: Tables) -> DataFrame:
    scores = evaluate.task_scores(t.v_eval, "model", "task_name", "is_correct")
    models = report.run_names(scores, "model")
    matrix = report.score_matrix(scores, "task_name", "model", models)
    return matrix.select("task_name", *[F.round(F.col(f"`{m}`"), 6).alias(m) for m in models])


RECORDED_SQL = """, computed as (select model, task_name, avg(is_correct) as score from v_eval group by all),
recorded as (select source as model, lang as task_name, avg(n_chars % 2) as score from documents
  where lang <> 'fr' and source <> (select max(source) from documents) group by all)"""


def recorded_scores(t: Tables) -> DataFrame:
    """Scores that summaries record: the last run has no summary, and no summary has the task ``fr``."""
    last = t.documents.agg(F.max("source")).scalar()
    docs = t.documents.where((F.col("lang") != "fr") & (F.col("source") != last)).select(
        F.col("source").alias("model"), F.col("lang").alias("task_name"), (F.col("n_chars") % 2).alias("hit")
    )
    return evaluate.task_scores(docs, "model", "task_name", "hit")


@query(
    "merge_scores",
    with_views("v_eval")
    + RECORDED_SQL
    + """
select model, task_name, round(score, 6) as score, 'recorded' as origin from recorded
union all select model, task_name, round(score, 6), 'computed' from computed where model not in (select model from recorded)""",
)
def merge_scores(t: Tables) -> DataFrame:
    computed = evaluate.task_scores(t.v_eval, "model", "task_name", "is_correct")
    return evaluate.merge_scores(recorded_scores(t), computed, ["model", "task_name"]).withColumn("score", F.round("score", 6))


# Lines of a report in SQL, from cells (k, model, v), models (model, total, place) and the format of a share.
def lines_sql(title: str, digits: int, missing: str) -> str:
    share = lambda v: f"printf('%.{digits}f%%', round_even(({v}) * 100, {digits}))"
    return f"""
, body as (select k, '| **' || k || '** | ' || string_agg(coalesce({share("c.v")}, '{missing}'), ' | ' order by place) || ' |' as line
  from (select distinct k from cells) join models on true left join cells c using (k, model) group by k),
report as (select 0 as section, '' as k, '| {title} | ' || string_agg(model, ' | ' order by place) || ' |' as line from models
  union all select 1, '', '| :--- | ' || string_agg(':---:', ' | ') || ' |' from models
  union all select 2, k, line from body
  union all select 3, '', '| **TOTAL** | ' || string_agg('**' || {share("total")} || '**', ' | ' order by place) || ' |' from models)
select row_number() over (order by section, k) as line_no, line from report"""


@query(
    "task_report",
    with_views("v_eval")
    + RECORDED_SQL
    + """, rows_ as (select model, task_name, is_correct, case when ground_truth = '1' then '0' else '2' end as expected, prediction from v_eval),
anew as (select model, task_name, avg(case when prediction = expected then 1 else 0 end) as score from rows_ where task_name = 'es' group by all
  having bool_or(is_correct <> case when prediction = expected then 1 else 0 end)),
either as (select * from recorded union all select * from computed where model not in (select model from recorded)),
cells as (select task_name as k, model, score as v from either where (model, task_name) not in (select model, task_name from anew) union all select task_name, model, score from anew),
totals as (select c.model, case when c.model in (select model from recorded) and c.model not in (select model from anew) then any_value(r.total) else avg(v) end as total
  from cells c left join (select model, round(avg(score), 4) as total from recorded group by model) r on r.model = c.model group by c.model),
models as (select model, total, row_number() over (order by total desc, model) as place from totals)"""
    + lines_sql("Task", 2, "-"),
)
def task_report(t: Tables) -> DataFrame:
    """Summaries and result rows written to files, read back, merged by run, one task judged anew, as a report."""
    path = scratch_path(t.spark, "runs")
    by_run = report.score_maps(recorded_scores(t), "model", "task_name")
    mean = F.aggregate(F.map_values("task_scores"), F.lit(0.0), lambda a, x: a + x) / F.size("task_scores")
    summary = by_run.select(F.concat("model", F.lit("_task_results")).alias("run"), F.col("model").alias("model_name"), F.round(mean, 4).alias("cole_score"), "task_scores")
    summary.write.partitionBy("run").json(f"{path}/summaries")
    truth = F.when(F.col("ground_truth") == "1", F.lit("Well, yes")).otherwise(F.lit("No, it is not"))
    rows = t.v_eval.select("task_name", "prediction", truth.alias("ground_truth"), "is_correct", F.concat("model", F.lit("_task_results")).alias("run"))
    files.write_results(rows, f"{path}/rows")
    back = files.read_runs(t.spark, f"{path}/rows", "task_name string, prediction string, ground_truth string, is_correct int")
    return reports.numbered(reports.task_report(files.read_summaries(t.spark, f"{path}/summaries/*"), back, "es", "_task_results"))


@query(
    "relation_report",
    """with rows_ as (select p_brand as model, p_type as k, case when p_brand = (select min(p_brand) from part) then p_size % 2
  when p_size > 25 then 1 else 0 end as cm from part),
cells as (select k, model, sum(cm) / count(*) as v from rows_ group by all),
models as (select model, sum(cm) / count(*) as total, row_number() over (order by sum(cm) / count(*) desc, model) as place from rows_ group by model)"""
    + lines_sql("Relation", 1, "0.0%"),
)
def relation_report(t: Tables) -> DataFrame:
    """Result rows written per run and read back; one run has no targets and keeps its marks, the others are matched anew."""
    path = scratch_path(t.spark, "results")
    plain = t.part.agg(F.min("p_brand")).scalar()
    lists = F.when(F.col("p_size") > 25, F.array(F.lit("it's \\ no"), F.col("p_type"))).otherwise(F.array(F.lit("neither, \"nor\"")))
    rows = t.part.select(
        F.col("p_type").alias("lexical_functions"), F.when(F.col("p_brand") != plain, text.list_text(lists)).alias("targets"),
        F.concat(F.lit(" So "), "p_type", F.lit(" assistant")).alias("answer"), F.lit(7).alias("EM"), (F.col("p_size") % 2).alias("CM"), F.col("p_brand").alias("run"),
    )
    files.write_results(rows, path)
    back = files.read_runs(t.spark, path, "lexical_functions string, targets string, answer string, prediction string, EM int, CM int")
    return reports.numbered(reports.relation_report(back))


@query(
    "combinations_all",
    """with keep as (select l_returnflag || l_linestatus || '-' || l_linenumber as v from lineitem group by 1 having count(*) >= 100),
kept as (select l_orderkey, v from (select l_orderkey, l_returnflag || l_linestatus || '-' || l_linenumber as v from lineitem) join keep using (v)),
combos as (select l_orderkey, string_agg(v, ' + ' order by v) as combination from kept group by l_orderkey)
select combination, count(*) as n from combos group by combination""",
)
def combinations_all(t: Tables) -> DataFrame:
    """All combinations of frequent values per order with their counts."""
    value = F.concat("l_returnflag", "l_linestatus", F.lit("-"), F.col("l_linenumber").cast("string"))
    return profile.combination_counts(t.lineitem.select("l_orderkey", value.alias("v")), "l_orderkey", "v", 100)
