"""Quality classifier: tree paths over text statistics become weighted rules, and the rules Spark columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import blank_words, map_batches, text_bytes
from lexlake.llm.host_rules import repeated_words
from lexlake.llm.labelled import fit_sample, held_out
from lexlake.llm.trees import boost, lasso

STATISTICS = (
    "log_bytes", "word_bytes", "longest_word", "capitals", "digits", "symbols", "exclamations", "punctuation", "non_ascii",
    "unique_words", "top_word", "repeated_next", "repeated_windows", "repeated_lines", "line_words", "short_words", "marked_words",
)
ROUNDS, DEPTH = 40, 3
PENALTY = 0.001

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>@^_=+~\\{}[]"
_PUNCTUATION = b".,;:?!'\"()-"
_HIGH = bytes(range(128, 256))


def _count(text: bytes, kind: bytes) -> int:
    return len(text) - len(text.translate(None, kind))


def statistics(text: bytes) -> list[float]:
    """Values of ``STATISTICS``: rates between 0 and 1 but for sizes; an empty text has zeros."""
    words = blank_words(text)
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    letters = _count(text, _LETTERS)
    symbols = _count(text, _SYMBOLS)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log1p(size)),
        sum(map(len, words)) / n,
        float(np.log1p(max(map(len, counts)))),
        _count(text, _UPPER) / max(letters, 1),
        _count(text, _DIGITS) / size,
        symbols / size,
        text.count(b"!") / size,
        _count(text, _PUNCTUATION) / size,
        _count(text, _HIGH) / size,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        repeated_words(words) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        sum(c for w, c in counts.items() if len(w) <= 3) / n,
        sum(c for w, c in counts.items() if w[-1] in _SYMBOLS or w[-2:] == b"!!") / n,
    ]


def with_statistics(docs: DataFrame, more: list[Column], text: str = "text") -> DataFrame:
    """``more`` columns and one double per statistic of every row."""
    named = docs.select(*more, text_bytes(text).alias("__text"))
    names = [*named.columns[:-1], *STATISTICS]
    others = len(more)  # columns themselves cannot go to the tasks

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t) for t in batch.column(others).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:others], *(pa.array(found[:, i]) for i in range(len(STATISTICS)))], names
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields[:-1])
    return map_batches(named, work, f"{fields}, " + ", ".join(f"`{s}` double" for s in STATISTICS))


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted conjunctions of (statistic, at most?, threshold)."""

    intercept: float
    rules: tuple[tuple[tuple[tuple[int, bool, float], ...], float], ...]

    def column(self) -> Column:
        """The score as one Spark expression over the statistics."""
        odds = F.lit(self.intercept)
        for path, weight in self.rules:
            holds = F.lit(True)
            for f, most, t in path:
                c = F.col(STATISTICS[f])
                holds = holds & (c <= t if most else c > t)
            odds = odds + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, most, t in path:
        out &= (x[:, f] <= t) == most
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, penalty: float = PENALTY) -> RuleEnsemble:
    """Paths of boosted trees as rules, one per set of rows that they hold for, weighted by a lasso logistic regression.

    Without rows, or with one class only, there are no rules and the score is the smoothed share of label 1.
    """
    if len(y) < 2 or y.min() == y.max():
        share = (y.sum() + 1.0) / (len(y) + (1.0 if not len(y) or y.max() == 1 else 2.0))
        share = min(share, 0.999)
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    _, trees = boost(x, y, rounds, depth, least=min(3.0, len(y) / 50))
    found: dict[bytes, tuple] = {}
    for tree in trees:
        for path in tree.paths():
            holds = _holds(x, path)
            if 0 < holds.sum() < len(y):
                key = min(np.packbits(holds).tobytes(), np.packbits(~holds).tobytes())
                if key not in found or len(path) < len(found[key]):
                    found[key] = path
    paths = list(found.values())
    if not paths:
        share = y.mean()
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    matrix = np.stack([_holds(x, p) for p in paths], axis=1).astype(np.float64)
    intercept, weights = lasso(matrix, y.astype(np.float64), penalty)
    return RuleEnsemble(intercept, tuple((p, float(w)) for p, w in zip(paths, weights, strict=True) if abs(w) > 1e-6))


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> RuleEnsemble:
    """Fit on the bounded labelled sample (see ``labelled.fit_sample``); only its statistics reach the driver."""
    sample = fit_sample(docs, labels, label, key, text)
    rows = with_statistics(sample, [F.col("doc_id"), F.col("label")]).toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    x = np.stack([rows.column(s).to_numpy() for s in STATISTICS], axis=1)[order]
    return fit_rules(x, (rows.column("label").to_numpy()[order] > 0).astype(np.int64))


def score_quality(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``held_out``, ``score``, ``predicted``) of every row; null texts score as empty ones, repeated rows stay."""
    rows = with_statistics(docs, [F.col(f"`{key}`").cast("long").alias("doc_id")], text)
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
