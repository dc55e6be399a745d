"""Marked-up dictionaries and Markdown tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.functions.text import decode_entities, strip

_HIDDEN = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>"


def _attribute(start_tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(start_tag, rf"""(?s)\s{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    value = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return F.when(quoted != "", decode_entities(value))


def markup_dictionary(
    df: DataFrame, col: str, tag: str, attributes: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Start tags of one element at any depth, in document order, with attributes as columns."""
    visible = F.regexp_replace(F.col(col), _HIDDEN, "")
    tags = F.regexp_extract_all(
        visible, F.lit(rf"""(<{tag}(?:\s[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)?/?>)"""), F.lit(1)
    )
    found = df.select(*keep, F.posexplode(tags).alias("pos", "_tag"))
    return found.select(
        *keep, F.col("pos").cast("long").alias("pos"), *[_attribute(F.col("_tag"), a).alias(a) for a in attributes]
    )


def read_markup(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents, one row each. A dictionary file is a single tree of a few MB."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("markup"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Prompt templates: one row per relation and pattern, numbered from 1."""
    schema = "patterns array<struct<lf:string,free_pattern:array<string>,one_shot:string>>"
    entries = spark.read.option("multiLine", "true").schema(schema).json(path).select(F.inline("patterns"))
    return entries.select(
        "lf",
        F.coalesce("one_shot", F.lit("")).alias("one_shot"),
        F.posexplode("free_pattern").alias("_p", "pattern"),
    ).select("lf", (F.col("_p") + 1).alias("pattern_no"), "pattern", "one_shot")


def _cells(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\|"), strip), lambda c: c != "")


def parse_markdown(df: DataFrame, col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of a Markdown table per document: row number, header cells, row cells.

    The first line is the header, the second the ruler; blank lines and empty
    cells are dropped.
    """
    lines = F.split(F.col(col), r"\r?\n")
    body = F.filter(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), lambda x: strip(x) != "")
    return df.select(
        *keep, _cells(F.get(lines, F.lit(0))).alias("headers"), F.posexplode(body).alias("_p", "_line")
    ).select(*keep, (F.col("_p") + 1).alias("row_no"), "headers", _cells(F.col("_line")).alias("cells"))


def read_markdown_table(spark: SparkSession, path: str) -> DataFrame:
    return parse_markdown(spark.read.text(path, wholetext=True), "value")


def write_markdown(lines: DataFrame, path: str) -> None:
    """Write report lines in order as one text document. A report has a row per task."""
    lines.orderBy("section", "sort_key").select("line").coalesce(1).write.text(path)
