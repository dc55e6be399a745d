"""Training records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.catalog.base import Tables, query, with_views
from lexlake.functions import arrays
from lexlake.operators import records

QUESTION_SQL = "concat('Quelle est la cible pour la fonction lexicale ''', lf, ''' du terme ''', name, ''' (', pos, ') ?')"


def with_instruction(t: Tables) -> DataFrame:
    targets = F.when(F.col("n_targets") > 1, F.array("first_target")).otherwise(F.array().cast("array<string>"))
    return t.v_groups.select(
        "group_id",
        records.instruction_record(F.col("lf"), F.col("name"), F.col("pos")).alias("instruction"),
        records.first_target(targets, F.concat(F.lit("["), "first_target", F.lit("]"))).alias("response"),
    )


RECORDS_SQL = with_views("v_groups") + f""", r as (select group_id, {QUESTION_SQL} as instruction,
  case when n_targets > 1 then first_target else concat('[', first_target, ']') end as response from v_groups)
"""


@query("instruction_records", RECORDS_SQL + "select group_id, instruction, response from r")
def instruction_records(t: Tables) -> DataFrame:
    return with_instruction(t)


@query("chat_layout_inst", RECORDS_SQL + "select group_id, concat('<s>[INST] ', instruction, ' [/INST] ', response, ' </s>') as text from r")
def chat_layout_inst(t: Tables) -> DataFrame:
    return with_instruction(t).select(
        "group_id", records.chat_layout("inst", F.col("instruction"), F.col("response")).alias("text")
    )


@query(
    "chat_layout_chatml",
    RECORDS_SQL
    + "select group_id, concat(E'<|im_start|>user\\n', instruction, E'<|im_end|>\\n<|im_start|>assistant\\n', response, '<|im_end|>') as text from r",
)
def chat_layout_chatml(t: Tables) -> DataFrame:
    return with_instruction(t).select(
        "group_id", records.chat_layout("chatml", F.col("instruction"), F.col("response")).alias("text")
    )


@query("chat_layout_text", "select doc_id, md5(concat('<s> ', text, ' </s>')) as text_md5 from documents")
def chat_layout_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(records.chat_layout("text", F.col("text"))).alias("text_md5"))


@query(
    "render_conversation",
    """select conv_id, count(*) as n_turns, md5(concat(string_agg(concat('<|im_start|>', role, E'\\n', text, E'<|im_end|>\\n'), '' order by turn),
  E'<|im_start|>assistant\\n')) as rendered_md5 from conversations group by conv_id""",
)
def render_conversation(t: Tables) -> DataFrame:
    chats = records.render_conversation(t.conversations, "conv_id", "turn", "role", "text")
    return chats.select("conv_id", "n_turns", F.md5("rendered").alias("rendered_md5"))


SENTENCE_SQL = "concat('Fonction lexicale : ', lf, '. Terme : ', name, ' (', pos, '). Cible : ', first_target, '.')"


@query("mask_sentence", with_views("v_groups") + f"select group_id, {SENTENCE_SQL} as sentence from v_groups")
def mask_sentence(t: Tables) -> DataFrame:
    sentence = records.mask_sentence(F.col("lf"), F.col("name"), F.col("pos"), F.col("first_target"))
    return t.v_groups.select("group_id", sentence.alias("sentence"))


def vocab_sql(source: str) -> str:
    return f"""counts as (select token, count(*) as n from (select unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as token from {source}) group by token),
vocab as (select token, n, cast(row_number() over (order by n desc, md5(token)) + 2 as integer) as id from counts)
"""


@query("vocabulary", "with " + vocab_sql("documents") + "select token, n, id from vocab")
def vocabulary(t: Tables) -> DataFrame:
    return records.build_vocab(t.documents, "text")


MAX_LEN = 64
ENCODED_SQL = "with " + vocab_sql("documents") + f""", words as (select conv_id * 100 + turn as row_id, regexp_extract_all(lower(text), '\\p{{L}}+')[1:{MAX_LEN}] as w from conversations),
flat as (select row_id, unnest(range(len(w))) as p, unnest(w) as token from words),
ids as (select row_id, list(coalesce(v.id, 1) order by p) as ids from flat left join vocab v on v.token = flat.token group by row_id),
enc as (select words.row_id, list_concat(coalesce(ids, []::integer[]), list_resize([]::integer[], {MAX_LEN} - coalesce(len(ids), 0), 0)) as input_ids,
  list_concat(list_resize([]::integer[], coalesce(len(ids), 0), 1), list_resize([]::integer[], {MAX_LEN} - coalesce(len(ids), 0), 0)) as attention_mask
  from words left join ids on ids.row_id = words.row_id)
"""


def encoded(t: Tables) -> DataFrame:
    rows = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("row_id"), "text")
    return records.encode(rows, "row_id", "text", records.build_vocab(t.documents, "text"), MAX_LEN)


def joined(col) -> F.Column:
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


@query(
    "encode_pad",
    ENCODED_SQL + "select row_id, array_to_string(input_ids, ',') as input_ids, array_to_string(attention_mask, ',') as attention_mask from enc",
)
def encode_pad(t: Tables) -> DataFrame:
    return encoded(t).select(
        "row_id", joined("input_ids").alias("input_ids"), joined("attention_mask").alias("attention_mask")
    )


@query(
    "mask_target",
    with_views("v_groups")
    + f""", sent as (select group_id, name, {SENTENCE_SQL.replace('first_target', 'name')} as text from v_groups), {vocab_sql('sent')},
words as (select group_id, regexp_extract_all(lower(text), '\\p{{L}}+')[1:16] as w, regexp_extract_all(lower(name), '\\p{{L}}+') as tw from sent),
placed as (select *, list_filter(range(1, len(w) - len(tw) + 2), lambda i: w[i:i + len(tw) - 1] = tw)[1] as place from words),
flat as (select group_id, place, len(tw) as m, unnest(range(1, len(w) + 1)) as p, unnest(w) as token from placed),
tok as (select f.*, v.id, coalesce(p >= place and p < place + m, false) as hit from flat f join vocab v on v.token = f.token)
select group_id, concat(string_agg(case when hit then 2 else id end, ',' order by p), repeat(',0', (16 - count(*))::int)) as input_ids,
  concat(string_agg(case when hit then id else -100 end, ',' order by p), repeat(',-100', (16 - count(*))::int)) as labels from tok group by group_id""",
)
def mask_target(t: Tables) -> DataFrame:
    """The target is the term itself, so its first place is not the last words."""
    sentence = records.mask_sentence(F.col("lf"), F.col("name"), F.col("pos"), F.col("name"))
    rows = t.v_groups.select("group_id", "name", sentence.alias("text"))
    vocab = records.build_vocab(rows, "text")
    whole = records.encode(rows, "group_id", "text", vocab, 16)
    target = records.encode(rows, "group_id", "name", vocab, 16, pad=False).withColumnRenamed("input_ids", "target_ids")
    both = whole.join(target, "group_id")
    ids, size = F.col("input_ids"), F.size("target_ids")
    placed = both.withColumn("at", arrays.find_span(ids, F.col("target_ids")))
    return placed.select(
        "group_id",
        joined(arrays.mask_span(ids, F.col("at"), size, records.MASK_ID)).alias("input_ids"),
        joined(arrays.span_labels(ids, F.col("at"), size)).alias("labels"),
    )


@query(
    "mask_random",
    ENCODED_SQL
    + f"""select row_id, array_to_string(list_transform(range(0, {MAX_LEN}), lambda i: case when attention_mask[i + 1] = 1
    and substr(md5(concat('42|', row_id, '|', i)), 1, 8) < '{int(0.15 * 2**32):08x}' then 2 else input_ids[i + 1] end), ',') as masked,
  array_to_string(list_transform(range(0, {MAX_LEN}), lambda i: case when attention_mask[i + 1] = 1
    and substr(md5(concat('42|', row_id, '|', i)), 1, 8) < '{int(0.15 * 2**32):08x}' then input_ids[i + 1] else -100 end), ',') as labels from enc""",
)
def mask_random(t: Tables) -> DataFrame:
    ids = F.col("input_ids")
    masked = arrays.mask_random(ids, F.col("attention_mask"), F.col("row_id"), 0.15, 42, records.MASK_ID)
    rows = encoded(t).withColumn("hidden", masked)
    labels = arrays.masked_labels(ids, F.col("hidden"), records.MASK_ID)
    return rows.select("row_id", joined("hidden").alias("masked"), joined(labels).alias("labels"))


@query(
    "causal_labels",
    ENCODED_SQL + f"select row_id, array_to_string(list_transform(range(1, {MAX_LEN} + 1), lambda i: case when attention_mask[i] = 1 then input_ids[i] else -100 end), ',') as labels from enc",
)
def causal_labels(t: Tables) -> DataFrame:
    labels = arrays.causal_labels(F.col("input_ids"), F.col("attention_mask"))
    return encoded(t).select("row_id", joined(labels).alias("labels"))
