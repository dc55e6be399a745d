"""Training records: instructions, chat layouts, vocabulary and encoded sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.functions.text import strip
from lexlake.operators.keyed import fits, lookup, ordered_lists, spread
from lexlake.operators.sampling import PREFIX
from lexlake.operators.scoring import tokens_of
from lexlake.session import written

# Reserved ids of the word vocabulary.
PAD_ID, UNKNOWN_ID, MASK_ID, FIRST_WORD_ID = 0, 1, 2, 3

# The layouts of the training texts.
QUESTION = "Quelle est la cible pour la fonction lexicale '%s' du terme '%s' (%s) ?"
MASK_SENTENCE = "Fonction lexicale : %s. Terme : %s (%s). Cible : %s."
LAYOUTS = {
    "inst": "<s>[INST] %s [/INST] %s </s>",
    "chatml": "<|im_start|>user\n%s<|im_end|>\n<|im_start|>assistant\n%s<|im_end|>",
    "text": "<s> %s </s>",
}
TURN, CUE = "<|im_start|>%s\n%s<|im_end|>\n", "<|im_start|>assistant\n"


def first_target(targets: Column, raw: Column) -> Column:
    """The first target; the raw text if the list is empty."""
    return F.coalesce(F.get(targets, F.lit(0)), raw)


def instruction_record(relation: Column, name: Column, pos: Column) -> Column:
    return F.format_string(QUESTION, relation, name, pos)


def chat_layout(style: str, *parts: Column) -> Column:
    return F.format_string(LAYOUTS[style], *parts)


def mask_sentence(relation: Column, name: Column, pos: Column, target: Column) -> Column:
    return F.format_string(MASK_SENTENCE, *[strip(c) for c in (relation, name, pos, target)])


def render_conversation(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One chat text per conversation, ending with the cue for the next answer."""
    turns = F.format_string(TURN, F.col(role), F.col(text))
    return ordered_lists(df, [conv], turn, turns, "turns").select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.array_join("turns", ""), F.lit(CUE)).alias("rendered"),
    )


def build_vocab(df: DataFrame, text: str) -> DataFrame:
    """(token, n, id): ids by descending count, ties in the order of the token's md5.

    The md5 order cuts the huge tie groups of rare tokens into prefix cells, so
    no task ever numbers the whole vocabulary: offsets come from the counts per
    (n, cell), places from a window inside one cell.
    """
    counts = written(
        spread(df.select(text))
        .select(F.explode(tokens_of(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n")),
        "token-counts",
    ).withColumn("h", F.md5("token")).withColumn("cell", F.substring("h", 1, PREFIX))
    cells = counts.groupBy("n", "cell").agg(F.count(F.lit(1)).alias("size"))
    by_count = cells.groupBy("n").agg(F.sum("size").alias("size"))
    # One row per distinct count: below the square root of twice the corpus tokens.
    higher = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    count_start = by_count.select("n", F.coalesce(F.sum("size").over(higher), F.lit(0)).alias("a"))
    # At most 16**PREFIX cells per count.
    earlier = Window.partitionBy("n").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_start = cells.select("n", "cell", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("b"))
    starts = cell_start.join(count_start, "n").select(
        "n", "cell", (F.col("a") + F.col("b")).alias("start")
    )
    place = F.row_number().over(Window.partitionBy("n", "cell").orderBy("h"))
    numbered = counts.join(starts, ["n", "cell"]).select(
        "token", "n", (F.col("start") + place - 1 + F.lit(FIRST_WORD_ID)).cast("int").alias("id")
    )
    return written(numbered, "vocabulary")


def encode(
    df: DataFrame, row_id: str, text: str, vocab: DataFrame, max_len: int, pad: bool = True
) -> DataFrame:
    """Token ids cut at ``max_len``, padded on the right, with the attention mask.

    The cut comes before the join, so a long text sends no more than ``max_len``
    tokens; common tokens are spread (see ``lookup``).
    """
    words = spread(df.select(row_id, text)).select(
        row_id, F.posexplode(F.slice(tokens_of(F.col(text)), 1, max_len)).alias("p", "token")
    )
    vocab = vocab.select("token", "id")
    if not fits(vocab):  # the words are read twice then, see ``lookup``
        words = written(words, "words")
    ids = lookup(words, vocab, ["token"])
    packed = ids.groupBy(row_id).agg(
        F.array_sort(
            F.collect_list(F.struct("p", F.coalesce("id", F.lit(UNKNOWN_ID)).alias("id")))
        ).alias("l")
    )
    seq = F.coalesce(F.transform("l", lambda s: s["id"]), F.array().cast("array<int>"))
    joined = df.select(row_id).join(packed, row_id, "left").select(row_id, seq.alias("ids"))
    if not pad:
        return joined.select(row_id, F.col("ids").alias("input_ids"))
    fill = lambda v: F.array_repeat(F.lit(v), F.lit(max_len) - F.size("ids"))
    return joined.select(
        row_id,
        F.concat("ids", fill(PAD_ID)).alias("input_ids"),
        F.concat(F.transform("ids", lambda x: F.lit(1)), fill(0)).alias("attention_mask"),
    )
