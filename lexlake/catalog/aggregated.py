"""Aggregates, profiles and totals."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.catalog.base import Tables, lf_of, query, with_views
from lexlake.operators import evaluate, profile
from lexlake.operators.keyed import ordered_lists, sorted_sets
from lexlake.operators.scoring import candidate_pool, tokens_of


@query(
    "agg_ordered_list",
    """select conv_id, count(*) as n_turns, md5(string_agg(concat(role, ':', text), '|' order by turn)) as turns_md5
from conversations group by conv_id""",
)
def agg_ordered_list(t: Tables) -> DataFrame:
    turns = ordered_lists(t.conversations, ["conv_id"], "turn", F.concat_ws(":", "role", "text"), "turns")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.md5(F.array_join("turns", "|")).alias("turns_md5")
    )


@query(
    "agg_sorted_set",
    with_views("v_targets")
    + "select name, pos, lf, count(*) as n_targets, string_agg(target, '|' order by target) as targets from v_targets group by all",
)
def agg_sorted_set(t: Tables) -> DataFrame:
    sets = sorted_sets(t.v_rel, ["name", "pos", "lf"], "target", "targets")
    return sets.select(
        "name", "pos", "lf", F.size("targets").cast("long").alias("n_targets"), F.array_join("targets", "|").alias("targets")
    )


@query("value_counts", "select lang, count(*) as n from documents where lang is not null group by lang")
def value_counts(t: Tables) -> DataFrame:
    return profile.value_counts(t.documents, "lang")


@query(
    "value_shares",
    "select source, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from documents where source is not null group by source",
)
def value_shares(t: Tables) -> DataFrame:
    return profile.value_shares(t.documents, "source").withColumn("share", F.round("share", 6))


@query(
    "null_profile",
    """with j as (select d.doc_id, d.lang, d.source, l.quality, l.toxic from documents d left join labels l on l.doc_id = d.doc_id)
select 'doc_id' as column_name, count(*) - count(doc_id) as nulls from j union all select 'lang', count(*) - count(lang) from j
union all select 'source', count(*) - count(source) from j union all select 'quality', count(*) - count(quality) from j
union all select 'toxic', count(*) - count(toxic) from j""",
)
def null_profile(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    return profile.null_profile(joined)


@query(
    "top_n_other",
    """with c as (select source, count(*) as n, row_number() over (order by count(*) desc, source) as r from documents group by source)
select case when r <= 5 then source else 'Other' end as source, cast(sum(n) as bigint) as n from c group by 1""",
)
def top_n_other(t: Tables) -> DataFrame:
    return profile.top_n_other(t.documents, "source", 5)


@query(
    "element_counts",
    "select token, count(*) as n from (select unnest(regexp_extract_all(lower(text), '\\p{L}+')) as token from conversations) group by token",
)
def element_counts(t: Tables) -> DataFrame:
    return profile.element_counts(t.conversations, tokens_of(F.col("text")), "token")


@query("frequent_keys", with_views("v_rel") + "select lf, count(*) as n from v_rel group by lf having count(*) >= 1000")
def frequent_keys(t: Tables) -> DataFrame:
    return profile.frequent_keys(t.v_rel, "lf", 1000)


@query(
    "combination_counts",
    with_views("v_rel")
    + """, keep as (select lf from v_rel group by lf having count(*) >= 1000),
pairs as (select source, lf, count(*) as times from v_rel where lf in (select lf from keep) group by all),
combos as (select source, string_agg(concat(lf, 'x', times), ' + ' order by lf) as compact,
  string_agg(concat(repeat(concat(lf, ' + '), times - 1), lf), ' + ' order by lf) as combination from pairs group by source)
select combination, n from (select compact, combination, count(*) as n from combos group by all) order by n desc, compact limit 20""",
)
def combination_counts(t: Tables) -> DataFrame:
    return profile.combination_counts(t.v_rel, "source", "lf", 1000, 20)


@query(
    "histogram",
    """with e as (select min(n_chars) as lo, max(n_chars) as hi from documents),
b as (select cast(least(floor((n_chars - lo) / ((hi - lo) / 20.0::double)), 19) as integer) as bin from documents, e)
select i::integer as bin, round(lo + i * (hi - lo)::double / 20, 6) as lower, round(lo + (i + 1) * (hi - lo)::double / 20, 6) as upper,
  (select count(*) from b where b.bin = i) as n from range(20) r(i), e""",
)
def histogram(t: Tables) -> DataFrame:
    bins = profile.histogram(t.documents, "n_chars", 20)
    return bins.select("bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n")


@query(
    "length_summary",
    """with s as (select length(unnest(string_split(text, '.'))) as len from documents)
select count(*) as count, round(avg(len), 6) as mean, median(len)::double as median, max(len) as max, min(len) as min from s""",
)
def length_summary(t: Tables) -> DataFrame:
    sentences = t.documents.select(F.explode(F.split("text", r"\.")).alias("s"))
    return profile.length_summary(sentences, F.length("s")).withColumn("mean", F.round("mean", 6))


@query(
    "list_size_distribution",
    with_views("v_groups") + "select n_targets as size, count(*) as n from v_groups group by 1",
)
def list_size_distribution(t: Tables) -> DataFrame:
    return profile.list_size_distribution(t.v_groups, F.col("n_targets"))


@query(
    "candidate_pool",
    """select concat('LF_', length(bin(l_suppkey + 1))) as lf, s_name as target, min(l_orderkey) as first_pos
from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2""",
)
def candidate_pool_query(t: Tables) -> DataFrame:
    line = t.lineitem.select("l_orderkey", "l_suppkey")
    named = line.join(t.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        lf_of(F.col("l_suppkey")).alias("lf"), F.col("s_name").alias("target"), "l_orderkey"
    )
    return candidate_pool(named, "lf", "target", "l_orderkey")


METRICS = """, m as (select concat('LF_', length(bin(p_size))) as lf, concat('P', p_partkey % 3) as pattern, p_partkey % 2 = 0 as k, p_partkey % 4 < 2 as s,
  case when p_size > 25 then 1 else 0 end as "EM", case when p_size > 10 then 1 else 0 end as "CM" from part)
"""


def metric_rows(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    return t.part.select(
        F.concat(F.lit("LF_"), F.length(F.bin("p_size"))).alias("lf"),
        F.concat(F.lit("P"), key % 3).alias("pattern"),
        (key % 2 == 0).alias("k"),
        (key % 4 < 2).alias("s"),
        (F.col("p_size") > 25).cast("int").alias("EM"),
        (F.col("p_size") > 10).cast("int").alias("CM"),
    )


MEANS = 'round(avg("EM"), 6) as "EM_mean", round(avg("CM"), 6) as "CM_mean"'


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("EM_mean", F.round("EM_mean", 6)).withColumn("CM_mean", F.round("CM_mean", 6))


BASE = "with " + METRICS[2:]


@query(
    "metric_by_condition",
    BASE + f"select concat('k=', k::int, ', s=', s::int) as condition, {MEANS} from m group by k, s",
)
def metric_by_condition(t: Tables) -> DataFrame:
    means = evaluate.metric_means(metric_rows(t), ["k", "s"])
    label = evaluate.condition_text(F.col("k"), F.col("s")).alias("condition")
    return rounded(means).select(label, "EM_mean", "CM_mean")


@query("metric_by_key_condition", BASE + f"select lf, k, s, {MEANS} from m group by lf, k, s")
def metric_by_key_condition(t: Tables) -> DataFrame:
    return rounded(evaluate.metric_means(metric_rows(t), ["lf", "k", "s"]))


@query("metric_by_key", BASE + f"select lf, {MEANS} from m group by lf")
def metric_by_key(t: Tables) -> DataFrame:
    return rounded(evaluate.metric_means(metric_rows(t), ["lf"]).orderBy(F.desc("EM_mean"), "lf"))


@query("metric_by_pattern", BASE + f"select lf, pattern, {MEANS} from m group by lf, pattern")
def metric_by_pattern(t: Tables) -> DataFrame:
    return rounded(evaluate.metric_means(metric_rows(t), ["lf", "pattern"]))


@query(
    "metric_grouping_sets",
    BASE
    + f"""select lf, pattern, k, s, cast(grouping(lf) * 8 + grouping(pattern) * 4 + grouping(k) * 2 + grouping(s) as bigint) as grouping_no, {MEANS}
from m group by grouping sets ((k, s), (lf, k, s), (lf), (lf, pattern))""",
)
def metric_grouping_sets(t: Tables) -> DataFrame:
    return rounded(evaluate.metric_grouping_sets(metric_rows(t), "lf", "pattern"))


@query("total_micro", with_views("v_eval") + "select model, round(avg(is_correct), 6) as micro from v_eval group by model")
def total_micro(t: Tables) -> DataFrame:
    return evaluate.total_micro(t.v_eval, "model", "is_correct").withColumn("micro", F.round("micro", 6))


SCORES = ", scores as (select model, task_name, avg(is_correct) as score from v_eval group by all)\n"


@query(
    "total_macro",
    with_views("v_eval") + SCORES + "select model, round(avg(score), 6) as macro from scores group by model",
)
def total_macro(t: Tables) -> DataFrame:
    scores = evaluate.task_scores(t.v_eval, "model", "task_name", "is_correct")
    return evaluate.total_macro(scores, "model").withColumn("macro", F.round("macro", 6))


@query(
    "run_completeness",
    with_views("v_eval")
    + SCORES
    + """select m.model, count(*) as total_tasks, count(s.score) as completed_tasks, count(*) - count(s.score) as failed_tasks
from (select distinct model from v_eval) m cross join (values ('de'), ('en'), ('es'), ('fr'), ('it')) k(task_name)
left join scores s on s.model = m.model and s.task_name = k.task_name group by m.model""",
)
def run_completeness(t: Tables) -> DataFrame:
    rows = t.v_eval
    scores = evaluate.task_scores(rows, "model", "task_name", "is_correct")
    return evaluate.run_completeness(scores, rows, ["de", "en", "es", "fr", "it"], "model", "task_name")


@query(
    "lift_over_base",
    with_views("v_eval")
    + """, totals as (select model, avg(is_correct) as total, cast(substr(model, 4) as int) as no from v_eval group by model)
select a.model, concat('family', a.no % 5) as family, round(a.total, 6) as total, round(b.total, 6) as base_total,
  round(a.total - b.total, 6) as difference, round(case when b.total <> 0 then a.total / b.total end, 6) as ratio
from totals a join totals b on b.no = a.no % 5 where a.no >= 5""",
)
def lift_over_base(t: Tables) -> DataFrame:
    totals = evaluate.total_micro(t.v_eval, "model", "is_correct")
    number = F.substring("model", 4, 9).cast("int")
    lifted = evaluate.lift_over_base(
        totals, "model", F.concat(F.lit("family"), number % 5), number < 5, "micro"
    )
    numeric = ["total", "base_total", "difference", "ratio"]
    return lifted.select("model", "family", *[F.round(c, 6).alias(c) for c in numeric])
