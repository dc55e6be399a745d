"""Labelled rows for fitting: a bounded sample, never from the held-out part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.session import written

# A classifier is fitted on at most this many labelled documents, those with the least md5 of their id.
FIT_ROWS = 20_000


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text leaves no rest modulo 5; a null id is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """(``doc_id``, ``text``, ``label``) of at most ``rows`` labelled documents, written once. The ids are few, so they are broadcast."""
    known = labels.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.where("label IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    found = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return written(found.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label"), "labelled")
