"""Prompts, matching, label parsing, candidate ranking and model scoring."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.catalog.base import Tables, query, with_views
from lexlake.functions import match, text
from lexlake.operators import evaluate, scoring
from lexlake.operators.keyed import sorted_sets, spread


@query(
    "kwic",
    with_views("v_occ")
    + """, w as (select *, greatest(0, st - 60) as l0, least(n_chars, en + 60) as r0 from v_occ),
e as (select *, case when l0 = 0 then 0 else greatest(0, length(regexp_extract(substr(text, 1, l0 + 1), '(?s)^.*[ \\n]')) - 1) end as l,
  r0 + length(regexp_extract(substr(text, r0 + 1), '^[^ \\n]*')) as r from w)
select doc_id, concat(case when l > 0 then '...' else '' end, trim(substr(text, l + 1, r - l), E' \\n\\t\\r'),
  case when r < n_chars then '...' else '' end) as snippet from e""",
)
def kwic_query(t: Tables) -> DataFrame:
    return spread(t.v_occ.select("doc_id", "text", "occurrence")).select("doc_id", text.kwic(F.col("text"), F.col("occurrence")).alias("snippet"))


@query(
    "parse_list",
    with_views("v_targets")
    + """select name, pos, lf, count(*) as n, string_agg(lower(target), '|' order by target) as targets from v_targets
group by all union all select name, 'raw', 'raw', 1, name from (select distinct name from v_targets)""",
)
def parse_list_query(t: Tables) -> DataFrame:
    sets = sorted_sets(t.v_rel, ["name", "pos", "lf"], "target", "targets")
    quoted = F.transform("targets", lambda x, i: F.when(
        i % 2 == 0, F.concat(F.lit("'"), x, F.lit(" '"))).otherwise(F.concat(F.lit('"'), x, F.lit('"'))))
    written = sets.select("name", "pos", "lf", F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")).alias("cell"))
    plain = t.v_rel.select("name").distinct().select("name", F.lit("raw").alias("pos"), F.lit("raw").alias("lf"), F.col("name").alias("cell"))
    parsed = written.unionByName(plain).withColumn("l", text.parse_list(F.col("cell")))
    return parsed.select("name", "pos", "lf", F.size("l").cast("long").alias("n"), F.array_join("l", "|").alias("targets"))


def scored(t: Tables, cleaned: Column) -> DataFrame:
    """Metrics of the answers, each compared with the targets of its brand as rows."""
    targets = t.v_answer_targets.select("p_brand", F.lower("target").alias("target"))
    return evaluate.score_answers(t.v_answers.withColumn("a", cleaned), targets, ["p_brand"], "a")


PAIRED = (
    with_views("v_answers", "v_answer_targets")
    + """, cleaned as (select p_partkey, p_brand, answer, trim(regexp_replace(trim(lower(coalesce(answer, ''))), 'assistant$', '')) as a from v_answers)
"""
)


@query(
    "exact_match",
    PAIRED + """select c.p_partkey, max(case when t.target is null then null when trim(lower(answer)) = lower(t.target) then 1 when answer is not null then 0 end) as em
from cleaned c left join v_answer_targets t on t.p_brand = c.p_brand group by c.p_partkey""",
)
def exact_match_query(t: Tables) -> DataFrame:
    return scored(t, F.lower(text.strip(F.col("answer")))).select("p_partkey", F.col("EM").alias("em"))


@query(
    "contain_match",
    PAIRED + """select c.p_partkey, max(case when answer is null or t.target is null then null when contains(lower(answer), lower(t.target)) then 1 else 0 end) as cm
from cleaned c left join v_answer_targets t on t.p_brand = c.p_brand group by c.p_partkey""",
)
def contain_match_query(t: Tables) -> DataFrame:
    return scored(t, F.lower("answer")).select("p_partkey", F.col("CM").alias("cm"))


@query("clean_answer", PAIRED + "select p_partkey, a as cleaned from cleaned")
def clean_answer_query(t: Tables) -> DataFrame:
    return t.v_answers.select("p_partkey", text.clean_answer(F.col("answer")).alias("cleaned"))


@query(
    "recompute_metrics",
    PAIRED
    + """select c.p_partkey, max(case when t.target is null then null when a = lower(t.target) then 1 else 0 end) as "EM",
  max(case when t.target is null then null when contains(a, lower(t.target)) then 1 else 0 end) as "CM",
  max(case when t.target is null then null when regexp_matches(a, concat('\\b', lower(t.target), '\\b')) then 1 else 0 end) as "WM"
from cleaned c left join v_answer_targets t on t.p_brand = c.p_brand group by c.p_partkey""",
)
def recompute_metrics_query(t: Tables) -> DataFrame:
    return scored(t, text.clean_answer(F.col("answer"))).select("p_partkey", "EM", "CM", "WM")


@query(
    "first_answer",
    "select conv_id, turn, trim(regexp_extract(text, '^[^\\n.,;]*'), E' \\n\\t\\r') as answer from conversations",
)
def first_answer_query(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.first_answer(F.col("text")).alias("answer"))


def prompt_items(t: Tables) -> DataFrame:
    context = F.when(F.col("n_targets") % 2 == 0, F.concat(F.lit(" "), "first_target", F.lit(" "))).otherwise(F.lit("  "))
    return t.v_groups.select("group_id", "name", "lf", context.alias("example"))


GRID_SQL = with_views("v_groups", "v_patterns") + """, grid as (
  select g.group_id, g.name, g.lf, p.pattern_no, p.pattern, p.one_shot, k, s,
    case when g.n_targets % 2 = 0 then g.first_target else '' end as context
  from v_groups g join v_patterns p on p.lf = g.lf cross join (values (false), (true)) a(k) cross join (values (false), (true)) b(s))
"""


@query(
    "render_prompt",
    GRID_SQL
    + """select group_id, pattern_no, k, s, concat(case when k and one_shot <> '' then concat(E'Exemple :\\n', one_shot, E'\\n\\n') else '' end,
  case when s and context <> '' then concat('(Contexte : "', context, E'")\\n') else '' end,
  'Q : ', replace(pattern, '<W>', name), E'\\nR :') as prompt from grid""",
)
def render_prompt_query(t: Tables) -> DataFrame:
    grid = evaluate.prompt_grid(prompt_items(t), t.v_patterns, "lf")
    prompt = evaluate.render_prompt(
        F.col("name"), F.col("pattern"), F.col("one_shot"), F.col("k"), F.col("s"), F.col("example")
    )
    return grid.select("group_id", "pattern_no", "k", "s", prompt.alias("prompt"))


@query(
    "prompt_grid_counts",
    GRID_SQL + "select lf, count(distinct group_id) as rows, count(distinct pattern_no) as templates, count(*) as prompts from grid group by lf",
)
def prompt_grid_counts(t: Tables) -> DataFrame:
    return evaluate.grid_sizes(t.v_groups, t.v_patterns, "lf")


LABEL_SQL = with_views("v_gen") + """, c as (select doc_id, gen_text, rtrim(trim(lower(gen_text)), '.,!?:') as c from v_gen)
select doc_id, case when c = '0' then '0' when c = '1' then '1' when starts_with(c, '0') then '0' when starts_with(c, '1') then '1'
  when regexp_matches(c, '\\b0\\b') and not regexp_matches(c, '\\b1\\b') then '0'
  when regexp_matches(c, '\\b1\\b') and not regexp_matches(c, '\\b0\\b') then '1' else gen_text end as label from c"""


@query("parse_label", LABEL_SQL)
def parse_label_query(t: Tables) -> DataFrame:
    return t.v_gen.select("doc_id", match.parse_label(F.col("gen_text"), ["0", "1"]).alias("label"))


@query("parse_label_column", LABEL_SQL)
def parse_label_column(t: Tables) -> DataFrame:
    """The labels of the task as a list column."""
    rows = t.v_gen.withColumn("labels", F.array(F.lit("0"), F.lit("1")))
    return rows.select("doc_id", match.parse_label(F.col("gen_text"), F.col("labels")).alias("label"))


THREE_WAY = with_views("v_gen") + """, r as (select doc_id, cast(doc_id % 4 as varchar) as prediction,
  case when contains(lower(truth_text), 'yes') then '0' when starts_with(lower(truth_text), 'no') then '2' else '1' end as expected from v_gen)
"""


@query(
    "relabel_inference",
    THREE_WAY + "select doc_id, expected, case when prediction = expected then 1 else 0 end as is_correct from r",
)
def relabel_inference(t: Tables) -> DataFrame:
    return relabelled(t).select("doc_id", "expected", "is_correct")


def relabelled(t: Tables) -> DataFrame:
    rows = t.v_gen.select(
        "doc_id", F.col("truth_text").alias("ground_truth"),
        F.concat(F.lit(" "), (F.col("doc_id") % 4).cast("string")).alias("prediction"),
    )
    return evaluate.relabel_three_way(rows)


@query(
    "relabel_totals",
    with_views("v_eval", "v_gen")
    + """, scores as (select model, task_name, avg(is_correct) as score from v_eval where task_name <> 'fr' group by all
  union all select e.model, 'fr', avg(case when cast(g.doc_id % 4 as varchar) =
    case when contains(lower(truth_text), 'yes') then '0' when starts_with(lower(truth_text), 'no') then '2' else '1' end then 1 else 0 end)
  from v_eval e join v_gen g on g.doc_id = e.doc_id where e.task_name = 'fr' group by e.model)
select model, round(avg(score), 6) as macro from scores group by model""",
)
def relabel_totals(t: Tables) -> DataFrame:
    """One task is scored anew and the macro total follows."""
    rows = t.v_eval.select("doc_id", "model", "task_name", "is_correct")
    fresh = rows.where("task_name = 'fr'").drop("is_correct").join(relabelled(t).select("doc_id", "is_correct"), "doc_id")
    both = rows.where("task_name <> 'fr'").unionByName(fresh)
    scores = evaluate.task_scores(both, "model", "task_name", "is_correct")
    return evaluate.total_macro(scores, "model").withColumn("macro", F.round("macro", 6))


@query(
    "label_accuracy",
    with_views("v_eval")
    + "select model, task_name, count(*) as n, round(avg(case when prediction = ground_truth then 1 else 0 end), 6) as accuracy from v_eval group by all",
)
def label_accuracy(t: Tables) -> DataFrame:
    rows = t.v_eval.withColumn("prediction", F.concat(F.lit(" "), "prediction", F.lit("\n")))
    return evaluate.label_accuracy(rows, ["model", "task_name"]).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "token_f1",
    """with pairs as (select a.conv_id * 100 + a.turn as pair_id, a.text as p, b.text as t from conversations a
  join conversations b on b.conv_id = a.conv_id and b.turn = a.turn - 1),
pt as (select pair_id, unnest(regexp_extract_all(lower(p), '[\\p{L}\\p{N}]+')) as w from pairs),
tt as (select pair_id, unnest(regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+')) as w from pairs),
pc as (select pair_id, w, count(*) as n from pt group by all), tc as (select pair_id, w, count(*) as n from tt group by all),
common as (select pc.pair_id, sum(least(pc.n, tc.n)) as common from pc join tc on tc.pair_id = pc.pair_id and tc.w = pc.w group by all)
select pairs.pair_id, cast(coalesce(c.common, 0) as bigint) as common, coalesce(a.n, 0) as n_pred, coalesce(b.n, 0) as n_true,
  round(case when a.n is null and b.n is null then 1.0 when coalesce(c.common, 0) = 0 then 0.0
    else 2 * (c.common / a.n) * (c.common / b.n) / (c.common / a.n + c.common / b.n) end, 6)::double as f1
from pairs left join common c on c.pair_id = pairs.pair_id
left join (select pair_id, count(*) as n from pt group by all) a on a.pair_id = pairs.pair_id
left join (select pair_id, count(*) as n from tt group by all) b on b.pair_id = pairs.pair_id""",
)
def token_f1(t: Tables) -> DataFrame:
    turns = t.conversations
    answered = turns.select("conv_id", "turn", F.col("text").alias("p"))
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("t"))
    pairs = answered.join(asked, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("pair_id"), "p", "t")
    return evaluate.token_f1(pairs, "pair_id", "p", "t").withColumn("f1", F.round("f1", 6))


@query(
    "squad_exact",
    """select conv_id, turn, case when lower(role) = 'user' then 1 else 0 end as em from conversations""",
)
def squad_exact(t: Tables) -> DataFrame:
    padded = F.concat(F.lit("«"), F.upper("role"), F.lit(" » !"))
    return t.conversations.select("conv_id", "turn", evaluate.squad_exact(padded, F.lit("User")).alias("em"))


@query("batch_answer", "select item_id, substr(text, 1, 20) as answer from benchmark")
def batch_answer(t: Tables) -> DataFrame:
    def load():
        return lambda prompts: prompts.str.slice(0, 20)

    return scoring.batch_answer(t.benchmark, load, prompt="text").select("item_id", "answer")


@query(
    "best_candidate",
    """with dims as (select vec_id, label, unnest(range(len(embedding))) as d, unnest(embedding)::double as x from embeddings),
cent as (select label, d, avg(x) as m from dims group by all),
scores as (select v.vec_id, c.label, sum(v.x * c.m) as score from dims v join cent c on c.d = v.d group by all)
select vec_id, cast(label as varchar) as prediction, round(score, 6) as score from (
  select *, row_number() over (partition by vec_id order by score desc, label) as r from scores) where r = 1""",
)
def best_candidate(t: Tables) -> DataFrame:
    """Candidates are the label centroids, the score is the dot product."""
    rows = t.embeddings.select("vec_id", "embedding", F.lit("all").alias("task_name"))
    pool = scoring.centroids(t.embeddings, "label", "embedding").select(
        F.lit("all").alias("task_name"), F.col("label").alias("candidate"), F.col("label").alias("first_pos"), "centroid"
    )
    best = scoring.best_candidate(
        rows, "vec_id", pool, "task_name", "candidate", "first_pos",
        lambda c: scoring.dot(F.col("embedding"), c["centroid"]),
    )
    return best.select("vec_id", "prediction", F.round("score", 6).alias("score"))


@query(
    "corpus_log_prob",
    """with words as (select doc_id, lang, unnest(regexp_extract_all(lower(text), '\\p{L}+')) as token from documents),
model as (select lang, token, count(*) as n from words group by all), total as (select lang, sum(n) as total from model group by lang),
v as (select count(distinct token) as v from model), dt as (select doc_id, token, count(*) as n from words group by all),
sc as (select dt.doc_id, t.lang, sum(dt.n * ln((coalesce(m.n, 0) + 1.0::double) / (t.total + v.v))) / sum(dt.n) as score
  from dt cross join total t cross join v left join model m on m.lang = t.lang and m.token = dt.token group by all),
best as (select *, row_number() over (partition by doc_id order by score desc, lang) as r from sc)
select d.doc_id, coalesce(b.lang, (select min(lang) from total)) as prediction, round(coalesce(b.score, -1e9::double), 5) as score
from documents d left join best b on b.doc_id = d.doc_id and b.r = 1""",
)
def corpus_log_prob(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", "text")
    model = scoring.unigram_model(docs, "lang", "text")
    scored = scoring.corpus_log_prob(docs, "doc_id", "text", model, "lang")
    return scored.select("doc_id", "prediction", F.round("score", 5).alias("score"))
