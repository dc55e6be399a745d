"""Odd rows that every operator must take, and plain forms of what operators compute."""

from pyspark.sql import types as T

LONG = "ab cd ef " * 20000

# Null in every column, empty and blank texts, a very long one, equal rows, ids out of order.
ODD = [
    (5, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 62),
    (3, None, "en", "a", None),
    (4, "", None, "b", 0),
    (None, "no id here", "en", None, 10),
    (7, " \t\n ", "en", "b", 4),
    (8, LONG, "en", "a", len(LONG)),
    (9, "É 日本語 ß́ \U0001f600 id1ot <s> [INST] ~", "fr", "b", 20),
    (9, "É 日本語 ß́ \U0001f600 id1ot <s> [INST] ~", "fr", "b", 20),
    (2, "x", "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """``df`` with columns whose names operators might want themselves."""
    from pyspark.sql import functions as F

    for name in ("k", "h", "fp", "key", "words", "score", "rate", "host", "part", "bm_words", "label", "node", "start"):
        df = df.withColumn(name, F.lit("taken"))
    return df


def plain(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]
