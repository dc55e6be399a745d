"""Sources and sinks: round trips through files must give the rows back."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.catalog.base import Tables, query, split_sql, with_views
from lexlake.operators.evaluate import task_scores
from lexlake.operators.joins import corpus_filter, duplicate_content, require_columns
from lexlake.operators.report import markdown_rows, run_names, score_maps, score_matrix, scores_long
from lexlake.operators.sampling import seeded_hash
from lexlake.functions.text import parse_percent, strip
from lexlake.session import scratch_path
from lexlake.sources import files, markup
from lexlake.streaming.corpus import streamed_corpus

@query("scan_delimited", "select n_nationkey, n_name, n_regionkey from nation")
def scan_delimited(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "delimited")
    files.write_delimited(t.nation, path)
    return files.read_delimited(t.spark, path, t.nation.schema)


@query("delimited_text_round_trip", "select doc_id, md5(text) as text_md5, lang from documents")
def delimited_text_round_trip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "delimited-text")
    docs = t.documents.select("doc_id", "text", "lang")
    files.write_delimited(docs, path, sep=",")
    back = files.read_delimited(t.spark, path, docs.schema, sep=",")
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("scan_required_columns", "select doc_id, lang, source from documents")
def scan_required_columns(t: Tables) -> DataFrame:
    return require_columns(t.documents, ["doc_id", "text", "lang"]).select("doc_id", "lang", "source")


@query(
    "markup_dictionary",
    """select page_id, cast(unnest(range(len(hits))) as bigint) as pos, unnest(hits) as href
from (select page_id, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<a [^>]*href="([^"]*)"', 1) as hits from pages)""",
)
def markup_dictionary(t: Tables) -> DataFrame:
    return markup.markup_dictionary(t.pages, "html", "a", ["href"], keep=["page_id"])


@query("json_envelope", "select doc_id, text, lang, source, n_chars from documents")
def json_envelope(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "envelope")
    files.write_envelope(t.documents, path, {"description": "documents", "version": "1"})
    return files.read_envelope(t.spark, path, t.documents.schema)


@query(
    "jsonl_round_trip",
    "select md5(trim(text, E' \\n\\t\\r')) as text_md5, length(trim(text, E' \\n\\t\\r')) as n_chars from benchmark where trim(text, E' \\n\\t\\r') <> ''",
)
def jsonl_round_trip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "jsonl")
    files.write_jsonl(t.benchmark.select("text"), path)
    back = files.read_text_records(t.spark, path)
    return back.select(F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query(
    "json_field",
    "select cast(json_extract(props, '$.k') as bigint) as k, count(*) as n from events group by 1",
)
def json_field(t: Tables) -> DataFrame:
    schema = "struct<k:bigint>"
    parsed = t.events.select(F.from_json("props", schema)["k"].alias("k"))
    return parsed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(
    "scores_long",
    with_views("v_eval")
    + "select model as model_name, task_name, round(avg(is_correct), 6) as score from v_eval group by all",
)
def scores_long_query(t: Tables) -> DataFrame:
    scores = task_scores(t.v_eval, "model", "task_name", "is_correct")
    maps = score_maps(scores, "model", "task_name").withColumnRenamed("model", "model_name")
    return scores_long(maps).withColumn("score", F.round("score", 6))


@query(
    "runs_by_file",
    with_views("v_eval")
    + "select model as run, count(*) as n, cast(sum(is_correct) as bigint) as correct from v_eval group by model",
)
def runs_by_file(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "runs")
    rows = t.v_eval.select("model", "task_name", "prediction", "ground_truth", "is_correct")
    rows.write.partitionBy("model").option("header", "true").csv(path)
    schema = rows.drop("model").schema
    back = files.read_runs(t.spark, path, schema)
    return back.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_correct").cast("long")).alias("correct")
    )


@query(
    "duplicate_content",
    """select doc_id, first_id, content_md5 from (
  select doc_id, md5(text) as content_md5, min(doc_id) over (partition by md5(text)) as first_id from documents)
where doc_id > first_id""",
)
def duplicate_content_query(t: Tables) -> DataFrame:
    return duplicate_content(t.documents, "doc_id", "text").select("doc_id", "first_id", "content_md5")


LABELLED = f""", {split_sql("v_groups")},
groups as (select *, row_number() over (partition by lf order by md5(concat('42|', group_id))) as r from v_groups),
labelled as (select g.*, case when r <= train then 'train' when r <= upto then 'val' else 'test' end as split from groups g join cuts using (lf))
"""


@query(
    "split_write_counts",
    with_views("v_groups") + LABELLED + "select split, count(*) as n from labelled group by split",
)
def split_write_counts(t: Tables) -> DataFrame:
    from lexlake.operators.sampling import stratified_split

    path = scratch_path(t.spark, "splits")
    files.write_splits(stratified_split(t.groups_table(), "group_id", "lf", seed=42), path)
    return files.read_splits(t.spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "markdown_rows",
    with_views("v_eval")
    + """, scores as (select task_name, model, avg(is_correct) as score from v_eval group by all)
select task_name, count(*) as cells, count(score) as filled, round(sum(score), 6) as total from (
  select t.task_name, m.model, s.score from (select distinct task_name from v_eval) t
  cross join (select distinct model from v_eval) m
  left join scores s on s.task_name = t.task_name and s.model = m.model) group by task_name""",
)
def markdown_rows_query(t: Tables) -> DataFrame:
    """The table is written as Markdown lines, parsed again, and summed per task."""
    scores = task_scores(t.v_eval, "model", "task_name", "is_correct")
    models = run_names(scores, "model")
    lines = markdown_rows(
        score_matrix(scores, "task_name", "model", models), "task_name", models, digits=10
    ).where(F.col("section") == 2)
    cells = F.transform(F.split("line", r"\|"), strip)
    values = F.slice(F.filter(cells, lambda c: c != ""), 2, len(models))
    total = F.aggregate(values, F.lit(0.0), lambda acc, c: acc + parse_percent(c) / 100)
    return lines.select(
        F.col("sort_key").alias("task_name"),
        F.size(values).cast("long").alias("cells"),
        F.size(F.filter(values, lambda c: c != "-")).cast("long").alias("filled"),
        F.round(total, 6).alias("total"),
    )


@query(
    "markdown_round_trip",
    with_views("v_eval")
    + """, scores as (select task_name, model, avg(is_correct) as score from v_eval group by all)
select t.task_name, m.model, round(s.score, 6) as score from (select distinct task_name from v_eval) t
  cross join (select distinct model from v_eval) m
  left join scores s on s.task_name = t.task_name and s.model = m.model""",
)
def markdown_round_trip(t: Tables) -> DataFrame:
    """Pivot, Markdown document on disk, and back to one row per cell."""
    scores = task_scores(t.v_eval, "model", "task_name", "is_correct")
    models = run_names(scores, "model")
    matrix = score_matrix(scores, "task_name", "model", models)
    path = scratch_path(t.spark, "report")
    markup.write_markdown(markdown_rows(matrix, "task_name", models, digits=10), path)
    table = markup.read_markdown_table(t.spark, path)
    named = table.select(
        F.replace(F.get("cells", F.lit(0)), F.lit("**"), F.lit("")).alias("task_name"),
        F.inline(F.arrays_zip(F.slice("headers", 2, F.size("headers")).alias("model"), F.slice("cells", 2, F.size("cells")).alias("cell"))),
    )
    value = F.when(F.col("cell") != "-", parse_percent(F.col("cell")) / 100)
    return named.select("task_name", "model", F.round(value, 6).alias("score"))


CORPUS_SQL = """select doc_id, md5(substr(trim(text, E' \\n\\t\\r'), 1, 4000)) as text_md5,
  least(length(trim(text, E' \\n\\t\\r')), 4000) as n_kept from documents where length(trim(text, E' \\n\\t\\r')) >= 50"""


@query("corpus_filter", CORPUS_SQL)
def corpus_filter_query(t: Tables) -> DataFrame:
    kept = corpus_filter(t.documents.select("doc_id", "text"), "text")
    return kept.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_kept"))


# The path is written as a pattern because a stream takes a folder or a pattern, not a file.
@query("stream_corpus", CORPUS_SQL)
def stream_corpus_query(t: Tables) -> DataFrame:
    schema = t.documents.select("doc_id", "text").schema
    kept = streamed_corpus(t.spark, f"{t.folder}/documents.parque[t]", schema)
    return kept.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_kept"))


@query("stream_corpus_shuffled", CORPUS_SQL)
def stream_corpus_shuffled(t: Tables) -> DataFrame:
    schema = t.documents.select("doc_id", "text").schema
    kept = streamed_corpus(t.spark, f"{t.folder}/documents.parque[t]", schema, shuffle_seed=42, row_id="doc_id")
    return kept.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_kept"))
