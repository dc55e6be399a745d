"""Whole flows over the given tables: assembly, curation and judging."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.catalog.base import Tables, query, split_sql, with_views
from lexlake.catalog.cleaned import nodes_with_lists
from lexlake.catalog.judged import GRID_SQL, prompt_items
from lexlake.functions.arrays import list_len
from lexlake.functions.text import kwic
from lexlake.operators.evaluate import metric_means
from lexlake.operators.keyed import sorted_sets
from lexlake.plans import assemble, curate, judge
from lexlake.session import written

SETTINGS = curate.CurationSettings(at_least=200, budget=300, floor=10, seed=42, excluded=("LF_1",))


def records_with_examples(t: Tables) -> DataFrame:
    """Nodes with relation lists, and the document of the same number as their example."""
    nodes = nodes_with_lists(t).withColumnRenamed("pos", "POS")
    example = F.struct("text", "occurrence", F.lit(1).alias("position"))
    texts = t.v_occ.select(F.col("doc_id").alias("node_id"), F.array(example).alias("examples"))
    return nodes.join(texts, "node_id", "left")


@query(
    "curated_splits",
    with_views("v_edges", "v_occ")
    + """, keep as (select lf from v_edges group by lf having count(*) >= 200),
items as (select p.p_partkey as node_id, p.p_name as name, p.p_type as pos, e.lf, e.target
  from part p join v_edges e on e.node_id = p.p_partkey join keep on keep.lf = e.lf join documents d on d.doc_id = p.p_partkey),
w as (select *, greatest(0, st - 60) as l0, least(n_chars, en + 60) as r0 from v_occ),
x as (select *, case when l0 = 0 then 0 else greatest(0, length(regexp_extract(substr(text, 1, l0 + 1), '(?s)^.*[ \\n]')) - 1) end as l,
  r0 + length(regexp_extract(substr(text, r0 + 1), '^[^ \\n]*')) as r from w),
snip as (select doc_id, concat(case when l > 0 then '...' else '' end, trim(substr(text, l + 1, r - l), E' \\n\\t\\r'),
  case when r < n_chars then '...' else '' end) as example from x),
v_groups as (select concat(name, '||', pos, '||', lf) as group_id, name, pos, lf, min(node_id) as first_node from items where lf <> 'LF_1' group by name, pos, lf),
c as (select lf, count(*) as n from v_groups group by lf),
q as (select lf, n, greatest(cast(round_even(ln(1 + n) / sum(ln(1 + n)) over () * 300, 0) as bigint), 10) as quota from c),
lv as (select l, sum(least(q.quota, l)) as used from q, (select unnest(range(0, (select max(quota) from q) + 1)) as l) group by l),
best as (select max(l) as l, max_by(used, l) as used from lv where used <= 300),
r as (select q.*, best.l, 300 - best.used as spare, sum(case when quota > best.l then 1 else 0 end) over () as over_n,
  row_number() over (partition by quota > best.l order by n desc, lf) as rn from q, best),
trimmed as (select lf, least(quota, l) + case when quota > l and rn > over_n - spare then 1 else 0 end as quota from r),
taken as (select g.* from (select *, row_number() over (partition by lf order by md5(concat('42|', group_id))) as place from v_groups) g
  join trimmed t on t.lf = g.lf where place <= quota),
names as (select name, row_number() over (order by md5(concat('42|', name))) as i, count(*) over () as n from (select distinct name from taken)),
held as (select t.*, names.i <= ceil(names.n * 0.2::double) as held from taken t join names on names.name = t.name),
pool as (select * from held where not held),
"""
    + split_sql("pool")
    + """, seen as (select *, row_number() over (partition by lf order by md5(concat('42|', group_id))) as i from pool),
labelled as (select group_id, name, pos, s.lf, first_node, case when i <= train then 'train' when i <= upto then 'val' else 'test' end as split from seen s join cuts on cuts.lf = s.lf
  union all select group_id, name, pos, lf, first_node, 'unseen' from held where held),
targets as (select name, pos, lf, string_agg(target, '|' order by md5(concat('42|', target))) as targets from (select distinct name, pos, lf, target from items) group by all)
select l.group_id, l.split, md5(s.example) as example_md5, t.targets from labelled l
join snip s on s.doc_id = l.first_node join targets t on t.name = l.name and t.pos = l.pos and t.lf = l.lf""",
)
def curated_splits(t: Tables) -> DataFrame:
    """From records to labelled groups: threshold, snippet, quotas, sample, holdout, split."""
    done = curate.curate(written(records_with_examples(t), "records"), "node_id", SETTINGS)
    return done.select("group_id", "split", F.md5("example").alias("example_md5"), F.array_join("targets", "|").alias("targets"))


@query(
    "assembled_nodes",
    with_views("v_edges")
    + """, names as (select p_partkey as id, concat(case when p_size > 40 then 'se ' else '' end, p_name) as name from part),
defs as (select page_id, case when i.l is null then null else i.l end as l from (select page_id from pages) p left join (
  select page_id as pid, len(flatten(list(regexp_extract_all(b, '(?s)<li[^>]*>(.*?)</li>', 1)))) as l from (
    select page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<ul[^>]*>(.*?)</ul>', 1)) as b from pages) group by page_id) i on i.pid = p.page_id),
rel as (select e.node_id, count(*) as n_relations, string_agg(concat(case when e.lf = 'LF_7' then '' else concat('name ', e.lf) end, '>', coalesce(n.name, '?')), '|' order by e.ord) as relations
  from v_edges e left join names n on n.id = e.ord * 30 group by e.node_id)
select concat('n', p.p_partkey) as node_id, n.name, case when p.p_size % 10 = 0 then null else p.p_type end as pos, coalesce(r.n_relations, 0) as n_relations, r.relations,
  case when d.doc_id is null then 0 else 1 end as n_examples, coalesce(x.l, 0) as n_actants, p.p_size as status
from part p join names n on n.id = p.p_partkey left join rel r on r.node_id = p.p_partkey
left join documents d on d.doc_id = p.p_partkey left join defs x on x.page_id = p.p_partkey""",
)
def assembled_nodes(t: Tables) -> DataFrame:
    """The assembly on stand-in tables: parts as nodes, suppliers as edges, pages as definitions."""
    key = F.col("p_partkey")
    part = t.part
    nodes = part.select(
        F.concat(F.lit("n"), key).alias("id"), F.concat(F.lit("e"), key).alias("entry"),
        F.lit("I").alias("lexnum"), F.col("p_size").alias("status"), F.col("p_retailprice").alias("%"),
    )
    entries = part.select(
        F.concat(F.lit("e"), key).alias("id"), F.when(F.col("p_size") > 40, "se ").alias("addtoname"), F.col("p_name").alias("name")
    )
    grammar = part.select(
        F.concat(F.lit("n"), key).alias("node"), F.lit("()").alias("usagenote"), F.lit(None).cast("string").alias("usagenotevars"),
        F.when(F.col("p_size") % 10 != 0, F.concat(F.lit("g"), "p_type")).alias("POS"),
    )
    grammar_names = part.select(F.concat(F.lit("g"), "p_type").alias("id"), F.col("p_type").alias("name")).distinct()
    definitions = t.pages.select(
        F.concat(F.lit("n"), "page_id").alias("node"), F.lit("<p>x</p>").alias("def_HTML"),
        F.regexp_replace(F.regexp_replace("html", r"<(/?)ul\b", "<$1actantpos"), r"<(/?)li\b", "<$1tc").alias("def_XML"),
    )
    linked = written(t.v_edges.select("node_id", "lf", "ord"), "edges")  # read four times
    edges = linked.select(
        F.concat(F.lit("n"), "node_id").alias("source"), "lf", F.concat(F.lit("n"), F.col("ord") * 30).alias("target"), F.col("ord").alias("pos")
    )
    relations = linked.select("lf").distinct().where("lf <> 'LF_7'").select(
        F.col("lf").alias("id"), F.concat(F.lit("name "), "lf").alias("name"), F.lit("pa").alias("linktype")
    )
    links = t.documents.select(
        F.concat(F.lit("n"), "doc_id").alias("node"), F.concat(F.lit("x"), "doc_id").alias("example"),
        F.lit("(0;4)").alias("occurrence"), F.lit(1).alias("position"),
    )
    examples = t.documents.select(F.concat(F.lit("x"), "doc_id").alias("id"), F.lit("0").alias("status"), F.col("text").alias("content"))
    records = assemble.assemble(
        nodes, entries, grammar, grammar_names, definitions, edges, relations, links, examples
    )
    shown = F.transform("lf_dict", lambda x: F.concat(F.coalesce(x["lexical_function"], F.lit("")), F.lit(">"), F.coalesce(x["target"], F.lit("?"))))
    return records.select(
        "node_id", "name", F.col("POS").alias("pos"), list_len(F.col("lf_dict")).alias("n_relations"),
        F.array_join(shown, "|").alias("relations"), list_len(F.col("examples")).cast("int").alias("n_examples"),
        list_len(F.col("actants")).alias("n_actants"), "status",
    )


@query(
    "judged_answers",
    GRID_SQL
    + """, targets as (select group_id, name, pos, lf from v_groups), sets as (select concat(name, '||', pos, '||', lf) as group_id, lower(target) as target from v_targets),
ans as (select group_id, lf, pattern_no, k, s, concat('supplier#0000000', case when k then '01' else '10' end) as a from grid)
select lf, k, s, round(avg(em), 6) as "EM_mean", round(avg(cm), 6) as "CM_mean" from (
  select a.group_id, a.lf, pattern_no, k, s, max(case when t.target = a.a then 1 else 0 end) as em, max(case when contains(a.a, t.target) then 1 else 0 end) as cm
  from ans a join sets t on t.group_id = a.group_id group by all) group by lf, k, s""",
)
def judged_answers(t: Tables) -> DataFrame:
    """Grid, answers of a caller-given model, exact and contain match, means per condition."""
    targets = t.v_targets.select(F.concat_ws("||", "name", "pos", "lf").alias("group_id"), F.lower("target").alias("target"))
    items = prompt_items(t).withColumnRenamed("lf", "lexical_function")
    templates = t.v_patterns.withColumnRenamed("lf", "lexical_function")

    def load():
        def answer(prompts):
            shot = prompts.str.startswith("Exemple :")
            return shot.map({True: "Supplier#000000001, surely", False: "Supplier#000000010. Yes"})

        return answer

    results = judge.judged(items, templates, load, "echo", targets)
    results = results.withColumnRenamed("lexical_function", "lf")
    means = metric_means(results, ["lf", "k", "s"])
    return means.select("lf", "k", "s", F.round("EM_mean", 6).alias("EM_mean"), F.round("CM_mean", 6).alias("CM_mean"))
