"""Benchmark decontamination: an FM-index per shard of documents, searched backwards for test phrases."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import free_name, map_batches, plain_table, plain_words, text_bytes

WINDOW = 10
# Windows in one broadcast block; a larger benchmark comes as several blocks, which each task loads one by one.
BLOCK_WINDOWS = 200_000
# A suffix position is kept for every SAMPLE-th place of a shard's text.
SAMPLE = 8

_RUN = re.compile(rb"[^ ]+")


class WaveletMatrix:
    """Bit levels of an integer sequence with running counts: access and rank for whole arrays of queries."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.bits = max(1, int(size - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        current = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (current >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))).astype(np.int32))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            current = np.concatenate((current[bit == 0], current[bit == 1]))

    def rank_pair(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query: occurrences of ``symbol`` before ``low`` and before ``high``."""
        begin = np.zeros_like(low)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b, c = ones[begin], ones[low], ones[high]
            begin = np.where(up, zeros + a, begin - a)
            low = np.where(up, zeros + b, low - b)
            high = np.where(up, zeros + c, high - c)
        return low - begin, high - begin

    def access_rank(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row: its symbol, and how often the symbol stands before it."""
        symbol = np.zeros_like(row)
        begin = np.zeros_like(row)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            up = ones[row + 1] > ones[row]
            symbol = symbol * 2 + up
            a, b = ones[begin], ones[row]
            begin = np.where(up, zeros + a, begin - a)
            row = np.where(up, zeros + b, row - b)
        return symbol, row - begin


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling until no two ranks are equal; a suffix that ends comes first."""
    rank = symbols.astype(np.int64)
    known = 1
    n = len(symbols)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - known] = rank[known:] + 1
        both = rank * (int(rank.max(initial=0)) + 2) + ahead
        order = np.argsort(both, kind="stable")
        sorted_keys = both[order]
        fresh = np.concatenate(([0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])))
        if fresh[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        known *= 2


class FmIndex:
    """Burrows-Wheeler rows in a wavelet matrix, symbol starts, and sampled suffix positions."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        """``symbols`` end in the only 0."""
        order = suffix_order(symbols)
        self.n = len(symbols)
        before = symbols[order - 1]
        self.wavelet = WaveletMatrix(before.astype(np.int32), size)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=size)))).astype(np.int32)
        kept = order % SAMPLE == 0
        self.marked = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
        self.sampled = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases (rows of symbols, filled with 0 on the right), all at once from the last symbol."""
        low = np.zeros(len(phrases), np.int32)
        high = np.full(len(phrases), self.n, np.int32)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - back]
            a, b = self.wavelet.rank_pair(symbol, low[live], high[live])
            low[live] = self.starts[symbol] + a
            high[live] = self.starts[symbol] + b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back through the text until a sampled row comes."""
        found = np.zeros(len(rows), np.int64)
        steps = np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        current = rows.astype(np.int32)
        while len(todo):
            here = current[todo]
            hit = self.marked[here + 1] > self.marked[here]
            done = todo[hit]
            found[done] = self.sampled[self.marked[current[done]]] + steps[done]
            todo = todo[~hit]
            symbol, before = self.wavelet.access_rank(current[todo])
            current[todo] = self.starts[symbol] + before
            steps[todo] += 1
        return found % self.n


class Phrases:
    """A block of distinct windows as symbol rows, and the items that each belongs to."""

    def __init__(self, rows: list[tuple[list[bytes], list[str]]]) -> None:
        words = sorted({w for window, _ in rows for w in window})
        # 0 ends a shard, 1 stands for every word that no phrase has.
        self.vocabulary = {w: i + 2 for i, w in enumerate(words)}
        self.lengths = np.array([len(w) for w, _ in rows], np.int64)
        width = int(self.lengths.max(initial=1))
        self.symbols = np.zeros((len(rows), width), np.int32)
        for i, (window, _) in enumerate(rows):
            self.symbols[i, : len(window)] = [self.vocabulary[w] for w in window]
        self.items = [items for _, items in rows]
        # By symbol: words of the shortest phrase that has it.
        self.least = np.full(len(words) + 2, np.iinfo(np.int32).max, np.int32)
        np.minimum.at(self.least, self.symbols.ravel(), np.repeat(self.lengths, width).astype(np.int32))
        self.least[:2] = np.iinfo(np.int32).max


def search_shard(docs: list[list[bytes]], phrases: Phrases) -> tuple[list[np.ndarray | None], list[set[str]]]:
    """Per document: the hit words as booleans (None: no hit) and the items found."""
    hits: list[np.ndarray | None] = [None] * len(docs)
    items: list[set[str]] = [set() for _ in docs]
    flat: list[bytes] = []
    for words in docs:
        flat += words
        flat.append(b"")  # no phrase goes from one document to the next
    starts = np.concatenate(([0], np.cumsum([len(words) + 1 for words in docs])))
    ids = np.fromiter(map(phrases.vocabulary.get, flat, repeat(1)), np.int32, len(flat))
    # A phrase lies inside a run of vocabulary words. A run is indexed if it is as long as a phrase of one of its words.
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 1).astype(np.int8), [0]))))
    begins, ends = edges[::2], edges[1::2]
    if not len(begins):
        return hits, items
    least = np.minimum.reduceat(phrases.least[ids], begins)  # what stands between runs asks for more than any run has
    fits = least <= ends - begins
    begins, sizes = begins[fits], (ends - begins)[fits] + 1
    if not len(begins):
        return hits, items
    at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    index = FmIndex(np.concatenate((ids[at], np.zeros(1, np.int32))), len(phrases.vocabulary) + 2)
    low, high = index.search(phrases.symbols, phrases.lengths)
    found = np.flatnonzero(low < high)
    if not len(found):
        return hits, items
    counts = (high - low)[found]
    rows = np.repeat(low[found] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    places = index.locate(rows)
    which = np.repeat(found, counts)
    edge = np.zeros(len(at) + 2, np.int32)  # removal spans merge in a running sum
    np.add.at(edge, places, 1)
    np.add.at(edge, places + phrases.lengths[which], -1)
    covered = at[np.cumsum(edge[: len(at)]) > 0]
    doc = np.searchsorted(starts, covered, side="right") - 1
    for d, w in zip(doc.tolist(), (covered - starts[doc]).tolist(), strict=True):
        if hits[d] is None:
            hits[d] = np.zeros(len(docs[d]), bool)
        hits[d][w] = True
    place_doc = np.searchsorted(starts, at[places], side="right") - 1
    pairs = np.unique(place_doc * len(phrases.items) + which)
    for d, p in zip((pairs // len(phrases.items)).tolist(), (pairs % len(phrases.items)).tolist(), strict=True):
        items[d].update(phrases.items[p])
    return hits, items


def _clean(text: bytes, hit: np.ndarray) -> bytes:
    """``text`` without the spans from the first to the last word of each hit run; a blank marks the cut."""
    plain = text.translate(plain_table())
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    places = [m.span() for m in _RUN.finditer(plain)]
    kept, last = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        kept.append(text[last : places[a][0]])
        last = places[b - 1][1]
    kept.append(text[last:])
    return b" ".join(kept)


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows as (words, items): ``window`` consecutive words, or all words of a shorter item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = plain_words(t)
                cuts = {b" ".join(words[k : k + window]) for k in range(max(1, len(words) - window + 1))} if words else set()
                ids += [i] * len(cuts)
                out += cuts
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary())], ["item", "words"])

    named = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")), text_bytes(text))
    rows = map_batches(named, cut, "item string, words binary")
    return rows.groupBy("words").agg(F.collect_set("item").alias("items"))


def _blocks(windows: DataFrame) -> list[Broadcast]:
    """The windows as broadcast blocks, each of at most about ``BLOCK_WINDOWS`` rows on the driver at a time."""
    spark = windows.sparkSession
    n = -(-windows.count() // BLOCK_WINDOWS)
    blocks = []
    for b in range(n):
        rows = windows.where(F.pmod(F.xxhash64("words"), F.lit(n)) == b).collect()
        blocks.append(spark.sparkContext.broadcast([(bytes(r["words"]).split(), sorted(r["items"])) for r in rows]))
    return blocks


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = 2_000_000,
) -> DataFrame:
    """``docs`` with ``bm_words``, ``bm_hit``, ``bm_items``, ``bm_spans`` and ``bm_text`` (underscores are added where taken).

    ``bm_hit`` counts the words inside any occurrence of a window, ``bm_items`` lists the items with such windows as sorted
    strings, ``bm_spans`` the merged runs of hit words as (first word from 0, words), ``bm_text`` the text without them.

    The documents of an Arrow batch, about ``shard_words`` words at a time, make a shard with its own FM-index; nothing is shuffled.
    Null texts have no words and stay null; rows are handled one by one, so repeated rows and ids keep
    their own results; a benchmark without words hits nothing; a null item id counts as the empty string.
    """
    blocks = _blocks(benchmark_windows(benchmark, item, item_text, window))
    names = {}
    taken = docs
    for wanted in ("bm_words", "bm_hit", "bm_items", "bm_spans", "bm_text"):
        names[wanted] = free_name(taken, wanted)
    cols = docs.columns
    place = cols.index(text)
    loaded: dict[int, Phrases] = {}

    def phrases(b: int) -> Phrases:
        if b not in loaded:
            loaded.clear()
            loaded[b] = Phrases(blocks[b].value)
        return loaded[b]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() if isinstance(t, str) else t for t in batch.column(place).to_pylist()]
            n_words, spans, found, cleaned = [], [], [], []
            at = 0
            while at < len(texts):
                shard: list[list[bytes]] = []
                size = 0
                while at < len(texts) and (not shard or size < shard_words):
                    shard.append(plain_words(texts[at] or b""))
                    size += len(shard[-1])
                    at += 1
                hits: list[np.ndarray | None] = [None] * len(shard)
                items: list[set[str]] = [set() for _ in shard]
                for b in range(len(blocks)):
                    more, also = search_shard(shard, phrases(b))
                    for d, (hit, names_) in enumerate(zip(more, also, strict=True)):
                        if hit is not None:
                            hits[d] = hit if hits[d] is None else hits[d] | hit
                        items[d] |= names_
                first = at - len(shard)
                for d, (words, hit) in enumerate(zip(shard, hits, strict=True)):
                    n_words.append(len(words))
                    found.append(sorted(items[d], key=lambda s: s.encode()))
                    if hit is None:
                        spans.append([])
                        cleaned.append(texts[first + d])
                        continue
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                    spans.append([{"start": a, "words": b - a} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
                    cleaned.append(_clean(texts[first + d], hit))
            hit_words = [sum(s["words"] for s in x) for x in spans]
            span = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
            more_arrays = [
                pa.array(n_words, pa.int64()), pa.array(hit_words, pa.int64()), pa.array(found, pa.list_(pa.string())),
                pa.array(spans, span), pa.array(cleaned, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more_arrays], [*cols, *names.values()])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    n = names
    fields += (
        f", `{n['bm_words']}` long, `{n['bm_hit']}` long, `{n['bm_items']}` array<string>, "
        f"`{n['bm_spans']}` array<struct<start:long,words:long>>, `{n['bm_text']}` string"
    )
    return map_batches(docs, work, fields)
