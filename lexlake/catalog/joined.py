"""Joins and set operations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.catalog.base import Tables, query, with_views
from lexlake.operators import joins
from lexlake.operators.keyed import lookup, sorted_sets


@query(
    "join_left_dimension",
    "select c_custkey, c_name, n_name from customer left join nation on n_nationkey = c_nationkey",
)
def join_left_dimension(t: Tables) -> DataFrame:
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return lookup(t.customer, nation, ["c_nationkey"]).select("c_custkey", "c_name", "n_name")


@query(
    "join_left_multi",
    """select o_orderkey, o_orderstatus, l_linenumber, l_partkey from orders left join lineitem on l_orderkey = o_orderkey""",
)
def join_left_multi(t: Tables) -> DataFrame:
    line = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    return orders.join(line, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", "l_linenumber", "l_partkey")


@query(
    "join_left_list",
    """with s as (select l_partkey, count(distinct s_name) as n, string_agg(distinct s_name, '|' order by s_name) as targets
  from lineitem join supplier on s_suppkey = l_suppkey group by l_partkey)
select p_partkey, coalesce(n, 0) as n_targets, targets from part left join s on l_partkey = p_partkey""",
)
def join_left_list(t: Tables) -> DataFrame:
    named = t.v_edges.select(F.col("node_id").alias("p_partkey"), "target")
    lists = sorted_sets(named, ["p_partkey"], "target", "targets")
    return t.part.select("p_partkey").join(lists, "p_partkey", "left").select(
        "p_partkey",
        F.coalesce(F.size("targets"), F.lit(0)).cast("long").alias("n_targets"),
        F.array_join("targets", "|").alias("targets"),
    )


@query(
    "join_left_detail",
    "select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l on l.doc_id = d.doc_id",
)
def join_left_detail(t: Tables) -> DataFrame:
    return lookup(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


@query(
    "join_left_composite",
    with_views("v_groups")
    + """, brands as (select p_name as name, p_type as pos, lf, min(p_brand) as example from part
  join (select distinct source, lf from v_rel) r on r.source = p_partkey where p_size > 25 group by all)
select g.group_id, b.example from v_groups g left join brands b on b.name = g.name and b.pos = g.pos and b.lf = g.lf""",
)
def join_left_composite(t: Tables) -> DataFrame:
    sources = t.v_rel.select("source", "lf").distinct()
    part = t.part.where("p_size > 25").select(
        F.col("p_partkey").alias("source"), F.col("p_name").alias("name"), F.col("p_type").alias("pos"), "p_brand"
    )
    brands = part.join(sources, "source").groupBy("name", "pos", "lf").agg(F.min("p_brand").alias("example"))
    return t.v_groups.join(brands, ["name", "pos", "lf"], "left").select("group_id", "example")


@query(
    "join_self_lookup",
    """with names as (select c_custkey % 1000 as id, max_by(c_name, c_custkey) as name from customer group by 1)
select c.c_custkey, n.name as target_name from customer c left join names n on n.id = (c.c_custkey * 7) % 1300""",
)
def join_self_lookup(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", ((F.col("c_custkey") * 7) % 1300).alias("ref"))
    names = t.customer.select((F.col("c_custkey") % 1000).alias("id"), "c_name", F.col("c_custkey").alias("row"))
    return joins.self_lookup(rows, "ref", names, "id", "c_name", "row", "target_name").select("c_custkey", "target_name")


@query(
    "join_semi",
    "select doc_id, lang from documents where doc_id in (select doc_id from labels)",
)
def join_semi(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id"), "doc_id", "left_semi")


@query(
    "join_anti",
    "select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
)
def join_anti(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query(
    "join_skip_report",
    with_views("v_groups", "v_patterns")
    + """select g.lf, case when p.lf is null then 'skipped' else 'kept' end as outcome, count(*) as n
from v_groups g left join (select distinct lf from v_patterns) p on p.lf = g.lf group by all""",
)
def join_skip_report(t: Tables) -> DataFrame:
    groups, templates = t.v_groups.select("lf", "group_id"), t.v_patterns
    kept = joins.join_templates(groups, templates.where("pattern_no = 1"), "lf")
    counted = kept.groupBy("lf").agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("kept"))
    skipped = joins.skipped_keys(groups, templates, "lf").withColumn("outcome", F.lit("skipped"))
    return counted.unionByName(skipped).select("lf", "outcome", "n")


@query(
    "cross_conditions",
    with_views("v_groups")
    + "select group_id, k, s from v_groups cross join (values (false), (true)) a(k) cross join (values (false), (true)) b(s)",
)
def cross_conditions(t: Tables) -> DataFrame:
    return joins.with_conditions(t.v_groups.select("group_id"), "k", "s")


@query(
    "join_contains",
    "select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)",
)
def join_contains(t: Tables) -> DataFrame:
    return joins.contain_join(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")


@query(
    "join_contains_words",
    """with words as (select distinct p_name as w from part union select distinct substr(n_name, 3, 3) from nation union select 'ct b')
select u.page_id as conv_id, w.w as word from (select conv_id * 100 + turn as page_id, concat(text, ' object blue bolt-ring NATION') as text from conversations) u
join words w on contains(u.text, w.w)""",
)
def join_contains_words(t: Tables) -> DataFrame:
    """Short targets: words, word parts and parts that cross a blank."""
    words = (
        t.part.select(F.col("p_name").alias("w"))
        .union(t.nation.select(F.substring("n_name", 3, 3)))
        .distinct()
        .union(t.region.groupBy().agg(F.lit("ct b").alias("w")))
    )
    rows = t.conversations.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("conv_id"),
        F.concat("text", F.lit(" object blue bolt-ring NATION")).alias("text"),
    )
    named = words.withColumn("word", F.col("w"))
    return joins.contain_join(rows, "conv_id", "text", named, "word", "w")


@query(
    "union_runs",
    "select origin, count(*) as n, cast(sum(length(text)) as bigint) as chars, count(lang) as with_lang from (select 'benchmark' as origin, text, null as lang from benchmark union all select 'documents', text, lang from documents) group by origin",
)
def union_runs(t: Tables) -> DataFrame:
    a = t.benchmark.select(F.lit("benchmark").alias("origin"), "text")
    b = t.documents.select(F.lit("documents").alias("origin"), "text", "lang")
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy("origin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.count("lang").alias("with_lang")
    )


@query(
    "intersect_ids",
    "select doc_id from documents where lang = 'fr' intersect select doc_id from labels where quality = 1",
)
def intersect_ids(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'fr'").select("doc_id").intersect(t.labels.where("quality = 1").select("doc_id"))


@query("except_ids", "select doc_id from documents except select doc_id from labels")
def except_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("distinct_pairs", with_views("v_groups") + "select distinct name, lf from v_groups")
def distinct_pairs(t: Tables) -> DataFrame:
    return t.v_groups.select("name", "lf").distinct()
