"""Chat formatting: render turns, reparse them, escape only what the parser would get wrong."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The marks of the template, and further control strings that no text may show.
TURN, BODY, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
# Stands after the first character of a control string in a text; one more is added to those that are there.
ESCAPE = "~"


def _groups() -> dict[str, str]:
    """First character of control strings -> pattern of what follows it."""
    firsts = sorted({c[0] for c in CONTROLS})
    return {f: "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == f) for f in firsts}


def shows_control(text: Column) -> Column:
    """Whether a text has a control string, plain or with escapes in it."""
    return text.rlike("|".join(f"{re.escape(f)}{ESCAPE}*(?:{rest})" for f, rest in _groups().items()))


def escape(text: Column) -> Column:
    """One more ``ESCAPE`` after the first character of each control string, escaped ones included.

    The result shows no control string. ``unescape`` gives the text back, since both work on the
    same places, which differ only in the number of escapes.
    """
    for first, rest in _groups().items():
        text = F.regexp_replace(text, f"{re.escape(first)}({ESCAPE}*)({rest})", f"{first}{ESCAPE}$1$2")
    return text


def unescape(text: Column) -> Column:
    for first, rest in _groups().items():
        text = F.regexp_replace(text, f"{re.escape(first)}{ESCAPE}({ESCAPE}*)({rest})", f"{first}$1$2")
    return text


def _piece(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), role, F.lit(BODY), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """The deterministic parser: array of (role, text) in order, from the marks alone.

    A turn is ``TURN role BODY text END`` and a line feed; the first ``BODY`` of a turn counts.
    """
    pieces = F.split(formatted, re.escape(END) + "\n", -1)

    def turn(piece: Column) -> Column:
        parts = F.split(F.substring(piece, len(TURN) + 1, 2**31 - 1), re.escape(BODY), 2)
        return F.struct(
            unescape(F.get(parts, 0)).alias("role"),
            unescape(F.coalesce(F.get(parts, 1), F.lit(""))).alias("text"),
        )

    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def format_conversations(
    turns: DataFrame,
    key: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    learned: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``key``, ``formatted``, ``turns``, ``loss_spans``.

    Each turn is rendered raw and parsed again. Where the parser does not give the turn back, or
    the text shows a control string, the turn is escaped. The whole conversation is then parsed; ``turns`` is
    what the parser read, and a conversation that differs from its source stops the job.
    ``loss_spans`` are (start, length) of the texts of the role ``learned`` in characters of ``formatted``, from 1.

    A null role or text counts as empty; null keys make one conversation; rows with the same
    ``order`` follow by role, then text, and repeated rows stay; null orders come first; no rows give no rows. Other
    columns are ignored, whatever their names. A conversation is one string, so its turns, and only they, meet in one task.
    """
    row = turns.select(
        F.col(f"`{key}`").alias("k"),
        F.col(f"`{order}`").alias("o"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("r"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"),
    )
    # Cheap test first: without "<" or "[" nothing can clash, and no pattern runs.
    suspect = F.col("t").rlike(r"[<\[]") | F.col("r").rlike(r"[<\[]")
    raw = parse(_piece(F.col("r"), F.col("t")))
    same = (F.size(raw) == 1) & (F.get(raw, 0)["role"] == F.col("r")) & (F.get(raw, 0)["text"] == F.col("t"))
    clash = suspect & (shows_control(F.col("t")) | shows_control(F.col("r")) | ~same)
    row = row.withColumn("clash", clash)
    row = row.select(
        "k", "o", "r", "t",
        F.when(F.col("clash"), escape(F.col("r"))).otherwise(F.col("r")).alias("er"),
        F.when(F.col("clash"), escape(F.col("t"))).otherwise(F.col("t")).alias("et"),
    )
    row = row.withColumn("piece", _piece(F.col("er"), F.col("et")))
    by = Window.partitionBy("k").orderBy("o", "r", "t")
    row = row.select(
        "k", "r", "t", "piece",
        F.row_number().over(by).alias("n"),
        (F.sum(F.length("piece")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece") + 1
         + len(TURN) + F.length("er") + len(BODY)).alias("start"),
        F.length("et").cast("long").alias("length"),
    )
    convs = row.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "r", "t", "piece", "start", "length"))).alias("rows"))
    convs = convs.select(
        "k",
        F.array_join(F.col("rows.piece"), "").alias("formatted"),
        F.transform("rows", lambda x: F.struct(x["r"].alias("role"), x["t"].alias("text"))).alias("source"),
        F.transform(
            F.filter("rows", lambda x: x["r"] == learned),
            lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")),
        ).alias("loss_spans"),
    )
    read = convs.withColumn("turns", parse(F.col("formatted")))
    failed = F.raise_error(F.lit("a conversation does not survive its round trip"))
    return read.select(
        F.col("k").alias(key),
        "formatted",
        F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(failed).alias("turns"),
        "loss_spans",
    )


def masked_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """Text under the loss mask, unescaped, nothing between the parts."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(F.col(formatted), s["start"].cast("int"), s["length"].cast("int")))), ""
    )
