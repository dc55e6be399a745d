"""Quality rules by host: rule failures of single documents, shrunk rates of hosts, verdicts back on documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import blank_words, map_batches, text_bytes

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
# A host whose shrunk failure rate is above this loses its documents.
HOST_LIMIT = 0.5

_NOT_COUNTED = bytes(range(0x80, 0xC0)) + b" \t\n\r\x0b\x0c"  # bytes inside a code point, and blanks
_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\r\x0b\x0c"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that stand twice or more in the list."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    new = count()
    ids = np.fromiter((numbers[w] if w in numbers else numbers.setdefault(w, next(new)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    keys = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        keys = (keys ^ (keys >> np.uint64(29))) * _MIX + ids[k : n - window + 1 + k].astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    left, right = order[:-1][same], order[1:][same]
    if any((ids[left + k] != ids[right + k]).any() for k in range(window)):  # two windows share a hash: compare them as they are
        seen: dict[tuple[int, ...], int] = {}
        wins = [tuple(ids[i : i + window].tolist()) for i in range(n - window + 1)]
        for w in wins:
            seen[w] = seen.get(w, 0) + 1
        places = np.array([i for i, w in enumerate(wins) if seen[w] > 1], np.int64)
    else:
        places = np.concatenate((left, right))
    edge = np.zeros(n + 1, np.int64)
    begin = np.zeros(n - window + 1, np.int64)
    begin[places] = 1
    edge[: n - window + 1] += begin
    edge[window:] -= begin
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a UTF-8 text."""
    words = blank_words(text)
    lines = [x for x in text.split(b"\n") if x.strip(_BLANKS)] if b"\n" in text else []
    return (
        len(words),
        len(text.translate(None, _NOT_COUNTED)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_failed(n_words: Column | None = None) -> Column:
    n_words = F.col("n_words") if n_words is None else n_words
    return (n_words < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n_words * REPEAT_PERCENT)


def document_measures(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """(``doc_id``, ``host``, the five measures, ``base_failed``) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measures(t) for t in batch.column(2).to_pylist()], np.int64).reshape(-1, len(NAMES))
            arrays = [batch.column(0), batch.column(1), *(pa.array(found[:, i]) for i in range(len(NAMES)))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "host", *NAMES])

    named = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{host}`").cast("string").alias("host"), text_bytes(text).alias("text"))
    measured = map_batches(named, work, "doc_id long, host string, " + ", ".join(f"{n} long" for n in NAMES))
    return measured.withColumn("base_failed", rule_failed())


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, host_rows, host_failed, host_rate, host_kept): failure rates shrunk by a beta prior fitted to all hosts.

    The prior has the mean and the spread of the hosts' rates (method of moments, each host once); where the rates
    spread no less than a coin or not at all, it counts as much as two documents.
    """
    hosts = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("host_rows"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")
    )
    rate = F.col("host_failed") / F.col("host_rows")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    strength = F.col("m") * (1 - F.col("m")) / F.nullif(F.col("v"), F.lit(0.0)) - 1
    prior = moments.select("m", F.greatest(F.coalesce(strength, F.lit(2.0)), F.lit(2.0)).alias("s"))
    mean, size = prior.select("m").scalar(), prior.select("s").scalar()
    shrunk = (F.col("host_failed") + mean * size) / (F.col("host_rows") + size)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_kept", F.col("host_rate") <= limit)


def host_rules(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: ``doc_id``, ``host``, the measures, ``base_failed``, ``host_rate``, ``kept``.

    Null texts have no words and fail; a null host is a host of its own; repeated rows are counted and returned as
    they are; no rows give no rows. Only counts per host are shuffled, combined in each task first; the verdicts are joined back by host.
    """
    from lexlake.session import written

    measured = written(document_measures(docs, key, host, text), "measures")
    verdicts = host_verdicts(measured, limit).select(F.col("host").alias("__host"), "host_rate", "host_kept")
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("__host")))
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("__host", "host_kept")
