"""Ranking, quotas, samples and splits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.catalog.base import Tables, query, with_views
from lexlake.catalog.scanned import LABELLED
from lexlake.functions.arrays import best_element, permute
from lexlake.operators import profile, sampling
from lexlake.operators.evaluate import total_micro
from lexlake.operators.keyed import ordered_lists, sorted_sets
from lexlake.operators.report import order_models

BUDGET, FLOOR, SEED = 700, 40, 42


@query(
    "first_per_key",
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber from (select *, row_number() over (partition by l_orderkey
  order by l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) as r from lineitem) where r = 1""",
)
def first_per_key(t: Tables) -> DataFrame:
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity"]
    rows = t.lineitem.select("l_orderkey", *order)
    return sampling.first_per_key(rows, ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query(
    "best_element",
    """select conv_id, turn as best_turn, md5(text) as best_md5 from (select *, row_number() over (partition by conv_id
  order by case when role = 'assistant' then length(text) end nulls last, turn) as r from conversations) where r = 1""",
)
def best_element_query(t: Tables) -> DataFrame:
    position = F.when(F.col("role") == "assistant", F.length("text"))
    item = F.struct("turn", "text", position.alias("position"))
    lists = ordered_lists(t.conversations, ["conv_id"], "turn", item, "turns")
    best = lists.select("conv_id", best_element(F.col("turns"), "position").alias("b"))
    return best.select("conv_id", F.col("b.turn").alias("best_turn"), F.md5("b.text").alias("best_md5"))


@query(
    "top_k_counts",
    "select p_name, count(*) as n from part group by p_name order by n desc, p_name limit 10",
)
def top_k_counts(t: Tables) -> DataFrame:
    return profile.top_k(t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("n")), 10, "p_name")


def quota_sql(budget: int, floor: int) -> str:
    return (
        f", c as (select lf, count(*) as n from v_groups group by lf),\n"
        f"q as (select lf, n, greatest(cast(round_even(ln(1 + n) / sum(ln(1 + n)) over () * {budget}, 0) as bigint), {floor}) as quota from c)\n"
    )


def trim_sql(budget: int, floor: int) -> str:
    return quota_sql(budget, floor) + f"""
, lv as (select l, sum(least(q.quota, l)) as used from q, (select unnest(range(0, (select max(quota) from q) + 1)) as l) group by l),
best as (select max(l) as l, max_by(used, l) as used from lv where used <= {budget}),
r as (select q.*, best.l, {budget} - best.used as spare, sum(case when quota > best.l then 1 else 0 end) over () as over_n,
  row_number() over (partition by quota > best.l order by n desc, lf) as rn from q, best),
trimmed as (select lf, n, cast(least(quota, l) + case when quota > l and rn > over_n - spare then 1 else 0 end as bigint) as quota from r)
"""


@query("class_quotas", with_views("v_groups") + quota_sql(BUDGET, FLOOR) + "select lf, n, quota from q")
def class_quotas(t: Tables) -> DataFrame:
    return sampling.class_quotas(t.v_groups, "lf", BUDGET, FLOOR)


@query("trim_quotas", with_views("v_groups") + trim_sql(BUDGET, FLOOR) + "select lf, n, quota from trimmed")
def trim_quotas(t: Tables) -> DataFrame:
    return sampling.trim_quotas(sampling.class_quotas(t.v_groups, "lf", BUDGET, FLOOR), "lf", BUDGET)


@query("trim_quotas_tight", with_views("v_groups") + trim_sql(250, FLOOR) + "select lf, n, quota from trimmed")
def trim_quotas_tight(t: Tables) -> DataFrame:
    return sampling.trim_quotas(sampling.class_quotas(t.v_groups, "lf", 250, FLOOR), "lf", 250)


@query(
    "stratified_take",
    with_views("v_groups")
    + trim_sql(BUDGET, FLOOR)
    + """, ranked as (select *, row_number() over (partition by lf order by md5(concat('42|', group_id))) as place from v_groups)
select r.group_id, r.lf from ranked r join trimmed t on t.lf = r.lf where r.place <= t.quota""",
)
def stratified_take(t: Tables) -> DataFrame:
    groups = t.groups_table()
    quotas = sampling.trim_quotas(sampling.class_quotas(groups, "lf", BUDGET, FLOOR), "lf", BUDGET)
    return sampling.stratified_take(groups, "lf", "group_id", quotas, SEED).select("group_id", "lf")


@query(
    "first_n_per_task",
    with_views("v_eval")
    + "select task_name, doc_id, model from (select *, row_number() over (partition by task_name order by doc_id) as r from v_eval) where r <= 25",
)
def first_n_per_task(t: Tables) -> DataFrame:
    return sampling.first_n(t.v_eval, 25, ["doc_id"], by=["task_name"]).select("task_name", "doc_id", "model")


@query("first_n", "select doc_id, lang from documents order by doc_id limit 100")
def first_n(t: Tables) -> DataFrame:
    return sampling.first_n(t.documents.select("doc_id", "lang"), 100, ["doc_id"])


@query(
    "seeded_sample",
    "select doc_id, lang from documents order by md5(concat('42|', doc_id)), doc_id limit 200",
)
def seeded_sample(t: Tables) -> DataFrame:
    return sampling.seeded_sample(t.documents.select("doc_id", "lang"), 200, SEED, "doc_id")


@query(
    "permute_list",
    with_views("v_targets")
    + "select name, pos, lf, string_agg(target, '|' order by md5(concat('42|', target))) as targets from v_targets group by all",
)
def permute_list(t: Tables) -> DataFrame:
    sets = sorted_sets(t.v_rel, ["name", "pos", "lf"], "target", "targets")
    return sets.select("name", "pos", "lf", F.array_join(permute(F.col("targets"), SEED), "|").alias("targets"))


HELD = """, names as (select name, row_number() over (order by md5(concat('42|', name))) as r, count(*) over () as n from (select distinct name from v_groups)),
held as (select g.*, names.r <= ceil(names.n * 0.2::double) as held from v_groups g join names on names.name = g.name)
"""


@query("holdout_unseen", with_views("v_groups") + HELD + "select group_id, name, held from held")
def holdout_unseen(t: Tables) -> DataFrame:
    return sampling.holdout_keys(t.groups_table(), "name", 0.2, SEED).select("group_id", "name", "held")


@query("stratified_split", with_views("v_groups") + LABELLED + "select group_id, lf, split from labelled")
def stratified_split(t: Tables) -> DataFrame:
    return sampling.stratified_split(t.groups_table(), "group_id", "lf", SEED).select("group_id", "lf", "split")


@query(
    "split_overlap",
    with_views("v_groups")
    + LABELLED
    + """select concat(a, '-', b) as pair, cast((select count(*) from (select group_id from labelled where split = a
  intersect select group_id from labelled where split = b)) as bigint) as shared
from (values ('train', 'val'), ('train', 'test'), ('val', 'test')) p(a, b)""",
)
def split_overlap(t: Tables) -> DataFrame:
    return sampling.split_overlap(sampling.stratified_split(t.groups_table(), "group_id", "lf", SEED), "group_id")


@query(
    "split_profile",
    with_views("v_groups")
    + LABELLED
    + "select split, lf, count(*) as n, round(count(*) / sum(count(*)) over (partition by split), 6) as share from labelled group by split, lf",
)
def split_profile(t: Tables) -> DataFrame:
    split = sampling.stratified_split(t.groups_table(), "group_id", "lf", SEED)
    return sampling.split_profile(split, "lf").withColumn("share", F.round("share", 6))


@query(
    "model_ranking",
    with_views("v_eval")
    + """, totals as (select model, round(avg(is_correct), 6) as micro from v_eval group by model)
select model, micro, cast(row_number() over (order by micro desc, model) as integer) as place from totals""",
)
def model_ranking(t: Tables) -> DataFrame:
    totals = total_micro(t.v_eval, "model", "is_correct").withColumn("micro", F.round("micro", 6))
    return order_models(totals, "model", "micro")
