"""Toxicity: boosted trees over dense features of a learned lexicon, with isotonic calibration."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import free_name, map_batches, plain_table, text_bytes
from lexlake.llm.labelled import fit_sample, held_out
from lexlake.llm.trees import Tree, boost, isotonic, sigmoid
from lexlake.session import written

# Whole words of the learned lexicon at most, as many beginnings of each length, and the documents of label 1 that a term needs: a number and a share.
LEXICON_TERMS = 500
LEAST_DOCUMENTS = 5
LEAST_SHARE = 0.005
# A term is this many times as frequent in documents of label 1.
LEAST_RATIO = 20.0
# Beginnings of words, in bytes, that count as terms besides whole words.
PREFIXES = (4, 5, 6, 8)  # ascending
NEAR = 5
# Words of the window whose hits count: a short passage counts alike in a short and in a long text.
WINDOW = 50
ROUNDS, DEPTH = 60, 3

# Words that address the reader.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros os su".encode().split()
)
# Characters that stand for letters.
LOOKALIKES = bytes.maketrans(b"0134578@$!", b"oieastbasi")

FEATURES = (
    "lexicon_words", "lexicon_prefixes", "lexicon_any", "lexicon_strength", "hidden_terms", "near_reader",
    "log_hits", "log_hidden", "log_near", "reader_words",
    "capitals", "exclamations", "punctuation", "mixed_words", "masked", "spaced", "stretched", "log_words",
)

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = b"0123456789"
_INNER = b"*.-_~'`"
_MIXED = re.compile(rb"[a-z][0-9]|[0-9][a-z]")
_STRETCHED = re.compile(rb"([a-z])\1\1")


@dataclass(frozen=True)
class Lexicon:
    """Terms with their log ratios: whole words, and beginnings of words by length."""

    words: dict[bytes, float]
    prefixes: dict[int, dict[bytes, float]]
    first: frozenset[bytes]  # what any term begins with, as far as the shortest beginnings go

    def find(self, word: bytes) -> tuple[int, float]:
        """(1: whole word, 2: beginning, 0: none; log ratio)."""
        if word[: PREFIXES[0]] not in self.first:
            return 0, 0.0
        if word in self.words:
            return 1, self.words[word]
        for size, known in self.prefixes.items():
            if word[:size] in known and len(word) >= size:
                return 2, known[word[:size]]
        return 0, 0.0


def lexicon_of(words: dict[bytes, float], prefixes: dict[int, dict[bytes, float]]) -> Lexicon:
    every = [*words, *(p for known in prefixes.values() for p in known)]
    return Lexicon(words, prefixes, frozenset(t[: PREFIXES[0]] for t in every))


def _words(text: bytes) -> list[bytes]:
    return text.translate(plain_table()).split()


def terms(text: bytes) -> set[bytes]:
    """Words of a lower-cased text, and their beginnings marked by ``^``."""
    words = set(_words(text))
    return words.union(*[{b"^" + w[:size] for w in words if len(w) >= size} for size in PREFIXES])


def densest(places: list[int], n: int, weights: list[float] | None = None) -> float:
    """Largest sum of weights (1 each by default) over ``WINDOW`` of ``n`` words in a row, per word; ``places`` ascend."""
    if not places:
        return 0.0
    at = np.array(places)
    total = np.concatenate(([0.0], np.cumsum(np.ones(len(at)) if weights is None else weights)))
    ends = np.searchsorted(at, at + WINDOW, side="left")
    return float((total[ends] - total[:-1]).max() / min(n, WINDOW))


def features(text: bytes, lexicon: Lexicon) -> list[float]:
    """Values of ``FEATURES`` for a UTF-8 text, zeros for an empty one.

    Lexicon and reader hits are taken as the densest window of the whole text and as logs of their numbers, which do not thin out
    with length; the others are rates per word or per byte.
    """
    lower = text.decode(errors="replace").lower().encode()
    words = _words(lower)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    distinct = set(words)
    known = {}
    start = lexicon.first
    for w in [w for w in distinct if w[: PREFIXES[0]] in start]:
        kind, strength = lexicon.find(w)
        if kind:
            known[w] = (kind, strength)
    hits, strengths, whole, begun, near = [], [], [], [], []
    readers = [w in SECOND_PERSON for w in words] if not distinct.isdisjoint(SECOND_PERSON) else None
    if known:
        for i, w in enumerate(words):
            if w in known:
                kind, s = known[w]
                hits.append(i)
                strengths.append(s)
                (whole if kind == 1 else begun).append(i)
                if readers is not None and any(readers[max(0, i - NEAR) : i + NEAR + 1]):
                    near.append(i)
    # What only shows once lookalikes are letters again and inner marks are gone.
    bare = lower.translate(LOOKALIKES, _INNER)
    hidden, unmasked = [], n
    if bare != lower:
        plain = _words(bare)
        found = {w for w in set(plain) - distinct if w[: PREFIXES[0]] in start and lexicon.find(w)[0]}
        if found:
            hidden, unmasked = [i for i, w in enumerate(plain) if w in found], len(plain)
    letters = size - len(text.translate(None, _LETTERS))
    mixed_words = len(_MIXED.findall(lower)) if size != len(text.translate(None, _DIGITS)) else 0
    singles = list(map(len, words)).count(1)
    stretched = len(_STRETCHED.findall(lower))
    return [
        densest(whole, n), densest(begun, n), densest(hits, n), densest(hits, n, strengths), densest(hidden, unmasked), densest(near, n),
        *np.log1p([len(hits), len(hidden), len(near)]).tolist(),
        sum(readers) / n if readers is not None else 0.0,
        (size - len(text.translate(None, _UPPER))) / max(letters, 1),
        text.count(b"!") / size,
        (size - len(text.translate(None, b".,;:?!'\"()-"))) / size,
        mixed_words / n, text.count(b"**") / n, singles / n, stretched / n, float(np.log1p(n)),
    ]


def _least_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, least): the least crc32 of three words in a row, which near copies mostly share."""
    for batch in batches:
        least = []
        for text in batch.column(0).to_pylist():
            words = _words(text)
            least.append(min((zlib.crc32(b" ".join(x)) for x in zip(words, words[1:], words[2:], strict=False)), default=zlib.crc32(text)))
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(least, pa.int64())], ["doc_id", "label", "least"])


def learn_lexicon(sample: DataFrame, limit: int = LEXICON_TERMS) -> Lexicon:
    """Terms that tell label 1 from 0 in the sample: counted per task, summed by term, and only the best reach the driver.

    At most ``limit`` whole words, and as many beginnings of each length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_label = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_label[label].update(terms(text.decode(errors="replace").lower().encode()))
            every = list(by_label[0].keys() | by_label[1].keys())
            arrays = [pa.array(every, pa.binary()), *(pa.array([by_label[v][t] for t in every], pa.int64()) for v in (0, 1))]
            yield pa.RecordBatch.from_arrays(arrays, ["term", "n0", "n1"])

    # Near copies of one text say no more than it does: one document per least shingle hash and label counts.
    labelled = sample.select(text_bytes("text").alias("text"), (F.col("label") > 0).cast("int").alias("label"), F.col("doc_id"))
    least = map_batches(labelled, _least_shingles, "doc_id long, label int, least long")
    chosen = least.groupBy("label", "least").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    rows = labelled.join(F.broadcast(chosen), "doc_id", "left_semi").select("text", "label")
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    summed = map_batches(rows, count, "term binary, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    zeros, ones = totals.get(0, 0), totals.get(1, 0)
    ratio = F.log((F.col("n1") + 0.5) / (ones + 1.0)) - F.log((F.col("n0") + 0.5) / (zeros + 1.0))
    good = written(
        summed.where(F.col("n1") >= max(LEAST_DOCUMENTS, LEAST_SHARE * ones))
        .withColumn("ratio", ratio)
        .where(F.col("ratio") >= float(np.log(LEAST_RATIO)))
        .where(F.col("n1") >= 20 * F.col("n0")),
        "terms",
    )
    # The bound holds for whole words and for the beginnings of each length on their own, so these take no place from words.
    kind = F.when(F.substring("term", 1, 1) == F.lit(b"^"), F.length("term") - 1).otherwise(0)
    ranked = [good.where(kind == k).orderBy(F.desc(F.col("n1") - 20 * F.col("n0")), "term").limit(limit) for k in (0, *PREFIXES)]
    best = reduce(DataFrame.union, ranked).collect()
    words, prefixes = {}, {size: {} for size in PREFIXES}
    for r in best:
        term = bytes(r["term"])
        if term[:1] == b"^":
            prefixes[len(term) - 1][term[1:]] = r["ratio"]
        else:
            words[term] = r["ratio"]
    return lexicon_of(words, prefixes)


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    start: float
    trees: tuple[Tree, ...]
    steps: tuple[np.ndarray, np.ndarray]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return sum((t.predict(x) for t in self.trees), np.full(len(x), self.start))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a hundredth of the raw one keeps the order inside a step."""
        raw = self.odds(x)
        if not len(self.steps[0]):
            return sigmoid(raw)
        return 0.99 * np.interp(raw, *self.steps) + 0.01 * sigmoid(raw)


def fit_trees(x: np.ndarray, y: np.ndarray, check: np.ndarray, lexicon: Lexicon) -> ToxicityModel:
    """Trees on the rows outside ``check``, calibration on those in it; one class only gives a constant score.

    Few rows of either class to check on: all rows are used for both.
    """
    none = (np.zeros(0), np.zeros(0))
    if len(y) < 2 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
        return ToxicityModel(lexicon, float(np.log(share / (1 - share))), (), none)
    if min(np.bincount(y[check], minlength=2).min(), np.bincount(y[~check], minlength=2).min()) < 20:
        fit = test = np.ones(len(y), bool)
    else:
        fit, test = ~check, check
    start, trees = boost(x[fit], y[fit], ROUNDS, DEPTH, least=min(3.0, fit.sum() / 100))
    model = ToxicityModel(lexicon, start, tuple(trees), none)
    return ToxicityModel(lexicon, start, tuple(trees), isotonic(model.odds(x[test]), y[test]))


def _with_features(rows: DataFrame, more: list[str], lexicon: Lexicon) -> DataFrame:
    """``more`` columns and the features as one array column ``x``; ``rows`` has the text as bytes in its last column."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, lexicon) for t in batch.column(len(more)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], [*more, "x"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_batches(rows, work, f"{fields}, x array<double>")


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Fit lexicon, trees and calibration on the bounded labelled sample; only its features reach the driver."""
    sample = fit_sample(docs, labels, label, key, text)
    lexicon = learn_lexicon(sample)
    named = sample.select("doc_id", (F.col("label") > 0).cast("int").alias("label"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).alias("check"), text_bytes("text"))
    rows = _with_features(named, ["doc_id", "label", "check"], lexicon).toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))[order]
    y = rows.column("label").to_numpy()[order].astype(np.int64)
    check = rows.column("check").to_numpy(zero_copy_only=False)[order].astype(bool)
    return fit_trees(x, y, check, lexicon)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "tox_score") -> DataFrame:
    """``docs`` with a double ``out`` between 0 and 1 (underscores are added where the name is taken).

    Null texts score as empty ones; every row gets its own score where it is, without a shuffle.
    """
    place = docs.columns.index(text)
    names = [*docs.columns, free_name(docs, out)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() if isinstance(t, str) else t or b"" for t in batch.column(place).to_pylist()]
            x = np.array([features(t, model.lexicon) for t in texts], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, work, f"{fields}, `{names[-1]}` double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``held_out``, ``score``, ``predicted``) of every row."""
    named = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    scored = score_toxicity(named, train_toxicity(docs, labels, "toxic", key, text), "text", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
