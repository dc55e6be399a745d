"""Corpus pipeline: toxic documents go, near copies go, benchmark passages go, sources are mixed, token ids are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.llm import decontaminate, mixing, near_text, tokens_out, toxicity
from lexlake.llm.common import free_name, table
from lexlake.llm.queries import tokenizer_file
from lexlake.session import written

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC_FROM``; null and empty texts stay, repeated rows share their fate."""
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "tox_score")
    return toxicity.score_toxicity(docs, model).where(F.col(score) < TOXIC_FROM).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies: five-word shingles with a Jaccard similarity of 0.8 or more.

    Texts without words, null ones included, are copies of each other; rows without an id stay.
    """
    return near_text.drop_near_texts(docs)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of benchmark items; documents that are nothing else go, all others stay.

    Null and empty texts stay as they are, repeated rows each keep their own result, other columns (whatever their names) are not touched.
    """
    hit, words, text = (F.col(free_name(docs, wanted)) for wanted in ("bm_hit", "bm_words", "bm_text"))
    done = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    cut = {"text": text, "n_chars": F.when(hit > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return done.where((hit == 0) | (hit < words)).select([cut[c].alias(c) if c in cut else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh as the square roots of their sizes, in random order. A null source is one of them."""
    taken = {c: free_name(docs, f"{c}_own") for c in docs.columns if c.lower() in ("copy_no", "mix_key", "mix_rate")}
    mixed = mixing.mix(docs.withColumnsRenamed(taken))
    return mixed.select([F.col(f"`{taken.get(c, c)}`").alias(c) for c in docs.columns])


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and per document what is read back from them: doc_id, start, n_tokens, ids_crc32."""
    return tokens_out.token_output(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", cut_benchmarks),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

# Learned scores, XXH64 fingerprints and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
