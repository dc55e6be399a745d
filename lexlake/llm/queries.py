"""The registered queries of the operators, with their SQL forms where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.llm import (
    chat, collocations, decontaminate, host_rules, mixing, quality_model, simhash, suffix, tokencount, tokens_out, toxicity, turn_repair, url_rules,
)
from lexlake.llm.common import table

# What both turns of the added conversation -1 say.
PROBE = "</s>[INST] ok [/INST]"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("turn"), F.lit(r).alias("role")) for n, r in enumerate(("user", "assistant"))])).alias("t"))
    probe = probe.select(F.lit(-1).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit(PROBE).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    done = chat.format_conversations(turns)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    done = done.withColumn("masked", chat.masked_text())
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"regexp_replace(regexp_replace({0}, '<(~*)(<SYS>>|</SYS>>|\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>)', '<~\1\2', 'g'), '\[(~*)(INST\]|/INST\])', '[~\1\2', 'g')"

OP1_SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + {len(chat.TURN) + len(chat.BODY) + len(chat.END) + 1}) as bigint)
         as formatted_chars
from rows group by conv_id"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return done.select(
        "doc_id",
        F.col("bm_words").alias("n_words"),
        F.col("bm_hit").alias("n_hit"),
        F.size("bm_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bm_items", ","), 256).alias("items_sha256"),
        (F.col("bm_hit") > 0).alias("contaminated"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item, n, list_aggregate(w[k:k + n - 1], 'string_agg', ' ') as s from (
    select item, w, least(10, len(w)) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from b where len(w) > 0)),
sizes as (select distinct n from win),
grams as (
  select doc_id, n, k, list_aggregate(w[k:k + n - 1], 'string_agg', ' ') as s from (
    select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d cross join sizes where len(w) >= n)),
hits as (select g.doc_id, g.k, g.n, win.item from grams g join win on win.n = g.n and win.s = g.s),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash.near_components(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.token_counts(docs, tokenizer_file("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality_model.score_quality(docs, model)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP6_SQL = """
with n as (select source, count(*) as rows from documents group by source),
rates as (select source, sqrt(cast(rows as double)) / (select sum(sqrt(cast(rows as double))) from n) * (select sum(rows) from n) / rows as rate from n),
terms as (select source, rate, unnest(range(0, cast(ceil(rate + sqrt(rate) * 12 + 40) as bigint) + 1)) as k from rates),
steps as (select source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) over (partition by source order by k) as upto from terms),
drawn as (
  select doc_id, source, cast('0x' || substr(md5(doc_id || '|0|copies'), 1, 13) as bigint) / pow(16.0, 13) as u from documents),
counts as (
  select d.doc_id, count(*) as n from drawn d join steps s on s.source is not distinct from d.source and s.upto <= d.u group by d.doc_id)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy_no, substr(md5(d.doc_id || '|0|place|' || c.copy_no), 1, 16) as mix_key, r.rate as mix_rate
from documents d join rates r on r.source is not distinct from d.source
join (select doc_id, cast(unnest(range(1, n + 1)) as integer) as copy_no from counts) c on c.doc_id = d.doc_id"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = host_rules.host_rules(table(spark, sf_dir, "documents"))
    return done.select("doc_id", *host_rules.NAMES, "base_failed", "kept", "host_rate")


OP8_SQL = r"""
with d as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
wins as (
  select doc_id, k, list_aggregate(w[k:k + 7], 'string_agg', ' ') as s from (
    select doc_id, w, unnest(range(1, len(w) - 6)) as k from d where len(w) >= 8)),
twice as (select doc_id, k from (select doc_id, k, count(*) over (partition by doc_id, s) as n from wins) where n > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(k, k + 8)) as p from twice) group by doc_id),
lines as (
  select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (
  select d.doc_id, d.source, cast(len(w) as bigint) as n_words,
         cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         coalesce(lines.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words
  from d left join lines using (doc_id) left join rep using (doc_id)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m),
h as (select source, count(*) as n, count(*) filter (where base_failed) as failed from f group by source),
mo as (select avg(failed / n) as m, var_pop(failed / n) as v from h),
pr as (select m, greatest(coalesce(m * (1 - m) / nullif(v, 0) - 1, 2.0), 2.0) as s from mo),
hv as (select source, (failed + m * s) / (n + s) as host_rate from h, pr)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and host_rate <= 0.5 as kept, host_rate
from f join hv on hv.source is not distinct from f.source"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_out.token_output(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report = turn_repair.repair_report(turn_repair.repair_turns(turn_repair.damage(turns)))
    every = turns.select("conv_id").distinct().alias("e")
    done = every.join(report.alias("r"), F.col("e.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    numbers = [F.coalesce(F.col(f"r.{n}"), F.lit(0)).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return done.select(
        "e.conv_id", *numbers, F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("r.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def _op11_sql() -> str:
    """The damage, then least costs with their edits from the last row to the first, by state: nothing, after s, after u, after a.

    A value is the cost in eight digits and the edits, so that the least one by its bytes is the cheapest and then the first in ASCII.
    """
    then = {0: 2, 1: 2, 2: 3, 3: 2}
    add = lambda v, c, e: f"(lpad(cast(cast({v}[1:8] as integer) + {c} as varchar), 8, '0') || '{e}' || {v}[9:])"
    keeps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    extra = "case when fault = 't' then 1 else 0 end"
    far = "'99999999'"
    edits = []
    for q in range(4):
        kept = " ".join(f"when ini = '{i}' then {add(f'v{to}', extra, 'K')}" for i, to in keeps[q].items())
        ways = [add(f"v{q}", 3, "D"), f"case when fault in ('b', 'd') then {far} else {add(f'v{then[q]}', f'2 + {extra}', 'R')} end"]
        ways.append(f"case when fault in ('b', 'd') then {far} {kept} else {far} end")
        edits.append(f"least({', '.join(ways)}) as w{q}")
    once = ", ".join(f"least(w{q}, {add(f'w{then[q]}', 2, 'I')}) as x{q}" for q in range(4))
    twice = ", ".join(f"least(x{q}, {add(f'x{then[q]}', 2, 'I')}) as v{q}" for q in range(4))
    byte = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end))"
    blanks = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
with recursive src as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         encode(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')) as k from conversations),
coded as (
  select *, xor(list_reduce(list_concat([4294967295], [cast(ascii(x) as bigint) for x in string_split(decode(k), '')]), lambda c, b: {byte}), 4294967295) % 20 as d from src),
hurt as (
  select conv_id, turn, case when d = 4 then 'user' else role end as role,
         case d when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case d when 0 then 0 when 3 then 2 else 1 end)) as copy from coded),
rows as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as p, count(*) over (partition by conv_id) as n,
         rtrim(text, {blanks}) as cut, role[1] as ini from hurt),
marked as (
  select *, case when cut = '' then 'b' when row_number() over (partition by conv_id, role, text order by p) > 1 then 'd'
                 when right(cut, 1) not in ('.', '!', '?') then 't' else '' end as fault,
         lag(ini) over (partition by conv_id order by p) || ini as pair from rows),
stat as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'b') as blank,
         count(*) filter (where fault = 'd') as duplicate, count(*) filter (where fault = 't') as truncated,
         count(*) filter (where p > 1 and pair not in ('su', 'ua', 'au')) as illegal from marked group by conv_id),
walk as (
  select conv_id, n as p, '00000000' as v0, '00000004II' as v1, '00000002I' as v2, '00000000' as v3 from (select distinct conv_id, n from rows)
  union all
  select conv_id, p, {twice} from (
    select conv_id, p, {once} from (
      select w.conv_id, w.p - 1 as p, {', '.join(edits)} from walk w join marked m on m.conv_id is not distinct from w.conv_id and m.p = w.p))),
best as (select conv_id, cast(v0[1:8] as bigint) as cost, v0[9:] as audit from walk where p = 0),
steps as (
  select conv_id, nr, edit, count(*) filter (where edit <> 'I') over (partition by conv_id order by nr) as p,
         count(*) filter (where edit <> 'D') over (partition by conv_id order by nr) as o from (
    select conv_id, audit[i] as edit, i as nr from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as i from best))),
said as (
  select s.conv_id, s.nr, s.edit, case when s.edit = 'K' then m.role end as kept, case when s.edit = 'I' then '' else m.text end as text, s.o,
         max(case when s.edit = 'K' and m.ini = 's' then 1 else 0 end) over (partition by s.conv_id) as sys
  from steps s left join marked m on s.edit <> 'I' and m.conv_id is not distinct from s.conv_id and m.p = s.p),
told as (
  select conv_id, string_agg(coalesce(kept, case when (o - sys) % 2 = 1 then 'user' else 'assistant' end) || ':' || text, chr(10) order by nr) as s
  from said where edit <> 'D' group by conv_id)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(s, '')) as repaired_sha256
from (select distinct conv_id from conversations) e
left join stat on stat.conv_id is not distinct from e.conv_id
left join best on best.conv_id is not distinct from e.conv_id
left join told on told.conv_id is not distinct from e.conv_id"""


OP11_SQL = _op11_sql()


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
with pieces as (
  select doc_id, coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select row_number() over () as piece_id, lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, cast(sum(len(w)) as hugeint) as n from words group by lang),
f as (
  select lang, phrase, len, count(*) as a from (
    select lang, len, unnest([array_to_string(w[k:k + len - 1], ' ') for k in range(1, len(w) - len + 2)]) as phrase
    from words, (select unnest(range(1, 6)) as len) where len(w) >= len)
  group by lang, phrase, len having count(*) >= 100),
parts as (select lang, phrase, len, a, string_split(phrase, ' ') as w from f),
cuts as (
  select c.lang, c.phrase, c.len, c.a, c.k, l.a as l, r.a as r, n, 1000::hugeint * c.a * n // (cast(l.a as hugeint) * r.a) as score
  from (select *, unnest(range(1, len)) as k from parts where len > 1) c join totals using (lang)
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[:c.k], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
held as (
  select distinct f.lang, f.phrase from (
    select lang, a, unnest(flatten([[array_to_string(w[i:i + m - 1], ' ') for i in range(1, len - m + 2)] for m in range(2, len)])) as part from parts where len > 2) x
  join f on f.lang = x.lang and f.phrase = x.part and 100 * x.a >= 100 * f.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from best where not exists (select 1 from held where held.lang = best.lang and held.phrase = best.phrase)
qualify rank <= 2000"""

# The rules of the query: host, path and verdict.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    done = url_rules.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return done.select("page_id", "host", "path", "rule", "verdict")


OP13_SQL = f"""
with rules(host, path, verdict) as (values {", ".join(str(r) for r in URL_RULES)}),
u as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (
  select row_number() over () as nr, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u)
select page_id, p.host, p.path, r.host || r.path as rule, coalesce(r.verdict, 'allow') as verdict
from p left join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
qualify row_number() over (partition by nr order by len(string_split(r.host, '.')) desc, length(r.path) desc) = 1"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_decontaminate, op3_simhash, op4_token_count, op5_quality, op6_mix, op7_toxicity, op8_host_rules,
        op9_suffix_dedup, op10_token_output, op11_turn_repair, op12_collocations, op13_url_filter,
    )
}
SQL: dict[str, str] = {
    "op1_chat_format": OP1_SQL, "op2_decontaminate": OP2_SQL, "op6_mix": OP6_SQL, "op8_host_rules": OP8_SQL, "op11_turn_repair": OP11_SQL,
    "op12_collocations": OP12_SQL, "op13_url_filter": OP13_SQL,
}
