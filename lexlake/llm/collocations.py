"""Phrase collocations: frequency-ranked ids, pairs counted in tiles, frequent pairs ranked again as the words of the next length."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from lexlake.llm.common import map_batches, text_bytes
from lexlake.session import written

LEAST = 100
WORDS = 5
TOP = 2000
NO_LANG = "und"
# Words that one task holds at a time; whole documents, so a longer one is a chunk of its own.
CHUNK_WORDS = 1 << 20
# Ranks along the side of a tile, and the pairs from which a tile is counted by direct address.
TILE = 256
DENSE = TILE * TILE // 16
# Tiles are dealt to buckets, at least so many and so many more that a bucket has about this many places to count; sums of a bucket are made up at that size.
BUCKETS = 128
BUCKET_PLACES = 1 << 20
# A pair of ranks is one number; a language would need some 2 * 10**11 words for ranks beyond this.
_RANK_BITS = 31

# A-Z in lower case; piece marks all become a full stop, which no word can hold.
_CUT = bytes(46 if c in b".,;:!?" or 10 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
# A chunk is a row of bucket -1 with its numbers in ``keys``, and a row per bucket with its distinct units, whose numbers go on from ``base``.
_CHUNK = "chunk long, lang string, bucket int, base long, size long, keys binary, counts binary"
_NAMES = [f.split()[0] for f in _CHUNK.split(", ")]


_PACK, _UNPACK = ZstdCompressor(level=1), ZstdDecompressor()


def packed(data: bytes) -> bytes:
    return _PACK.compress(data)


def unpacked(data: bytes) -> bytes:
    return _UNPACK.decompress(data)


def planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: high bytes are mostly zero and pack well."""
    return packed(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes())


def unplanes(data: bytes, kind: type = np.int64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(unpacked(data), np.uint8).reshape(width, -1).T).view(kind).ravel()


class _Ids(dict):
    """Numbers of keys in the order in which they come up; 0 is the cut between pieces."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def squeeze(seq: np.ndarray) -> np.ndarray:
    """``seq`` with one cut in place of several."""
    keep = seq != 0
    keep[1:] |= seq[:-1] != 0
    return seq[keep]


def count_pairs(code: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes, counts, place of each code among them) of pairs of ranks, each ``times`` or once; a code is left rank and right rank.

    Pairs fall into tiles of ``TILE`` x ``TILE`` neighbouring ranks. Low ranks are frequent, so their tiles are
    full and each pair is an address in an array of counts; what lies in thin tiles is sorted as coordinates.
    """
    tile = tile_of(code)
    order = np.argsort(tile, kind="stable")
    ordered = tile[order]
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(code) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate((begin, [len(order)])))
    place = np.zeros(len(code), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    full = sizes >= DENSE
    for at, size in zip(begin[full].tolist(), sizes[full].tolist(), strict=True):
        rows = order[at : at + size]
        left, right = np.divmod(code[rows], 1 << _RANK_BITS)
        address = left % TILE * TILE + right % TILE
        # Sums of counts are exact in floating point up to 2**53.
        count = np.bincount(address, None if times is None else times[rows], minlength=TILE * TILE)
        used = np.flatnonzero(count)
        local = np.zeros(TILE * TILE, np.int64)
        local[used] = np.arange(n, n + len(used))
        place[rows] = local[address]
        corner = (int(left[0]) // TILE * TILE << _RANK_BITS) + int(right[0]) // TILE * TILE
        found.append((corner + (used // TILE << _RANK_BITS) + used % TILE, count[used].astype(np.int64)))
        n += len(used)
    thin = order[np.repeat(~full, sizes)]
    if len(thin):
        thin = thin[np.argsort(code[thin], kind="stable")]
        sorted_code = code[thin]
        first = np.concatenate(([True], sorted_code[1:] != sorted_code[:-1]))
        heads = np.flatnonzero(first)
        place[thin] = n + np.cumsum(first) - 1
        count = np.diff(np.concatenate((heads, [len(thin)]))) if times is None else np.add.reduceat(times[thin], heads)
        found.append((sorted_code[heads], count))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), place
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), place


def tile_of(code: np.ndarray) -> np.ndarray:
    left, right = np.divmod(code, 1 << _RANK_BITS)
    return (left // TILE << _RANK_BITS) + right // TILE


def _bucket_of(tile: np.ndarray, buckets: int) -> np.ndarray:
    mixed = tile.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _rows(chunk: int, lang: str, seq: np.ndarray, bucket: np.ndarray, counts: np.ndarray, pack: Callable[[np.ndarray], bytes]) -> pa.RecordBatch:
    """The rows of a chunk: ``seq`` has numbers from 1 on of units with these buckets and counts, ``pack`` puts some units into bytes."""
    order = np.argsort(bucket, kind="stable")
    number = np.zeros(len(order) + 1, np.int32)
    number[order + 1] = np.arange(1, len(order) + 1)
    ordered = bucket[order]
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(order) else np.zeros(0, np.int64)
    cuts = list(zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True)) if len(order) else []
    keys = [planes(squeeze(number[seq])), *[pack(order[x:y]) for x, y in cuts]]
    sums = [None, *[planes(counts[order[x:y]]) for x, y in cuts]]
    n = len(keys)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([chunk] * n), pa.array([lang] * n), pa.array([-1, *ordered[begin].tolist()], pa.int32()), pa.array([0, *(begin + 1).tolist()], pa.int64()),
            pa.array([int((seq != 0).sum())] * n), pa.array(keys, pa.binary()), pa.array(sums, pa.binary()),
        ],
        _NAMES,
    )


def _word_chunks(docs: DataFrame, buckets: int) -> DataFrame:
    """Chunks of (``lang``, ``text``), the words of each in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        held: dict[str, tuple[_Ids, list[np.ndarray]]] = {}
        size = 0

        def chunks() -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            for lang, (ids, parts) in held.items():
                seq = squeeze(np.concatenate(parts))
                # In order of their bytes, so that neighbours share beginnings.
                words = sorted(list(ids)[1:])
                order = np.fromiter((ids[w] for w in words), np.int64, len(words))
                counts = np.bincount(seq, minlength=len(ids))[order]
                turn = np.zeros(len(ids), np.int32)
                turn[order] = np.arange(1, len(ids))
                bucket = np.fromiter((crc32(w) % buckets for w in words), np.int64, len(words))
                yield _rows(chunk, lang, turn[seq], bucket, counts, lambda at: packed(b" ".join([words[k] for k in at.tolist()])))  # noqa: B023
                chunk += 1
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in held:
                    held[lang] = (_Ids({b".": 0}), [])
                ids, parts = held[lang]
                tokens = text.translate(_CUT).replace(b".", b" . ").split()
                tokens.append(b".")
                parts.append(np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens)))
                size += len(tokens)
                if size >= CHUNK_WORDS:
                    yield from chunks()
                    size = 0
        yield from chunks()

    return map_batches(docs, work, _CHUNK)


def _pair_chunks(chunks: DataFrame, buckets: int) -> DataFrame:
    """Chunks of the next length from (``chunk``, ``lang``, ``keys``, ``ids``): ``ids`` are numbers in the chunk with their ranks.

    A place is a unit of the next length if the units there and at the next place are both frequent; its code is the two ranks.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, keys, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seq = unplanes(keys, np.int32)
                table = np.zeros(int(seq.max(initial=0)) + 1, np.int64)
                for part in ids:
                    table[unplanes(part["at"])] = unplanes(part["id"])
                ranks = squeeze(table[seq])
                pairs = np.flatnonzero((ranks[:-1] != 0) & (ranks[1:] != 0))
                if len(pairs):
                    code, counts, place = count_pairs((ranks[pairs] << _RANK_BITS) + ranks[pairs + 1])
                    later = np.zeros(len(ranks), np.int32)
                    later[pairs] = place + 1
                    by_code = lambda at: planes(np.diff(np.sort(code[at]), prepend=0))  # noqa: B023, E731
                    # Within a bucket units go by code.
                    order = np.argsort(code)
                    turn = np.zeros(len(code) + 1, np.int32)
                    turn[order + 1] = np.arange(1, len(code) + 1)
                    code, counts = code[order], counts[order]
                    yield _rows(chunk, lang, turn[later], _bucket_of(tile_of(code), buckets), counts, by_code)

    return map_batches(chunks.select("chunk", "lang", "keys", "ids"), work, _CHUNK)


class _Words:
    """Units of one word: counted in a dictionary."""

    kind = "binary"

    def __init__(self) -> None:
        self.sums: Counter[bytes] = Counter()

    def add(self, keys: bytes, counts: np.ndarray) -> None:
        sums = self.sums
        for word, n in zip(unpacked(keys).split(b" "), counts.tolist(), strict=True):
            sums[word] += n

    def frequent(self, least: int) -> tuple[list, list]:
        found = [(w, n) for w, n in self.sums.items() if n >= least]
        return [f[0] for f in found], [f[1] for f in found]

    @staticmethod
    def finder(keys: list, ids: list) -> Callable[[bytes], np.ndarray]:
        known = dict(zip(keys, ids, strict=True))
        return lambda cell: np.fromiter((known.get(w, 0) for w in unpacked(cell).split(b" ")), np.int64)


class _Pairs:
    """Units of two units of the length before: counted in tiles."""

    kind = "long"

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.settled = 0

    def add(self, keys: bytes, counts: np.ndarray) -> None:
        self.held.append((np.cumsum(unplanes(keys)), counts))
        self.size += len(counts)
        # Sums are made up whenever as much has come in as they hold themselves.
        if self.size >= 2 * self.settled + BUCKET_PLACES:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        code, times, _ = count_pairs(np.concatenate([h[0] for h in self.held]), np.concatenate([h[1] for h in self.held]))
        self.held, self.size, self.settled = [(code, times)], len(code), len(code)
        return code, times

    def frequent(self, least: int) -> tuple[list, list]:
        code, times = self.settle()
        return code[times >= least].tolist(), times[times >= least].tolist()

    @staticmethod
    def finder(keys: list, ids: list) -> Callable[[bytes], np.ndarray]:
        order = np.argsort(np.array(keys, np.int64))
        known, numbers = np.array(keys, np.int64)[order], np.array(ids, np.int64)[order]

        def find(cell: bytes) -> np.ndarray:
            code = np.cumsum(unplanes(cell))
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            return np.where(known[at] == code, numbers[at], 0)

        return find


def _sums(chunks: DataFrame, least: int, units: type) -> DataFrame:
    """(``lang``, ``bucket``, ``key``, ``a``) of the units that occur ``least`` times or more. Cells of a bucket pass one after another."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, units()

        def done() -> pa.RecordBatch:
            keys, a = held.frequent(least)
            arrays = [pa.array([now[0]] * len(a), pa.string()), pa.array([now[1]] * len(a), pa.int32())]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(keys, pa.binary() if units is _Words else pa.int64()), pa.array(a, pa.int64())], ["lang", "bucket", "key", "a"])

        for batch in batches:
            for lang, bucket, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (lang, bucket):
                    if now is not None:
                        yield done()
                    now, held = (lang, bucket), units()
                held.add(keys, unplanes(counts))
        if now is not None:
            yield done()

    cells = chunks.where("bucket >= 0").select("lang", "bucket", "keys", "counts")
    return map_batches(cells.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket"), work, f"lang string, bucket int, key {units.kind}, a long")


def _ids(chunks: DataFrame, frequent: DataFrame, units: type) -> DataFrame:
    """(``chunk``, ``at``, ``id``): the ranks of the frequent units of each cell. The ranks of a bucket come before its cells."""
    cells = chunks.where("bucket >= 0").select("lang", "bucket", "chunk", "base", "keys", F.lit(None).cast(units.kind).alias("key"), F.lit(None).cast("long").alias("id"))
    known = frequent.select("lang", "bucket", F.lit(None).cast("long").alias("chunk"), F.lit(0).cast("long").alias("base"), F.lit(None).cast("binary").alias("keys"), "key", "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, find, keys, ids = None, None, [], []
        for batch in batches:
            out = []
            for lang, bucket, chunk, base, cell, key, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (lang, bucket):
                    now, find, keys, ids = (lang, bucket), None, [], []
                if chunk is None:
                    keys.append(key)
                    ids.append(number)
                elif keys:
                    find = find or units.finder(keys, ids)
                    found = find(cell)
                    some = np.flatnonzero(found)
                    if len(some):
                        out.append((chunk, planes(some + base), planes(found[some])))
            kinds = (pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["chunk", "at", "id"])

    both = cells.union(known).repartition("lang", "bucket").sortWithinPartitions("lang", "bucket", F.col("chunk").asc_nulls_first())
    return map_batches(both, work, "chunk long, at binary, id binary")


def ranked(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Written ``df`` with ``name``: the place of a row in its group from 1 on, by ``order`` (unique within a group).

    Rows are dealt by ranges of group and order, so no group passes one task; a range adds the rows of its group that lie in earlier ranges.
    """
    keys = [F.col(group).asc(), *order]
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place_", F.monotonically_increasing_id())
    laid = written(laid, "ranges")
    # The upper bits of the place number the ranges.
    part = F.shiftright("place_", 33).alias("range_")
    firsts = laid.groupBy(F.col(group), part).agg(F.min("place_").alias("first_"), F.count(F.lit(1)).alias("rows_"))
    before = F.sum("rows_").over(Window.partitionBy(group).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    firsts = firsts.select(group, "range_", (F.coalesce(before, F.lit(0)) - F.col("first_") + 1).alias("shift_"))
    done = laid.withColumn("range_", part).join(firsts, [group, "range_"])
    return done.withColumn(name, F.col("place_") + F.col("shift_")).drop("place_", "range_", "shift_")


def _frequent(chunks: DataFrame, least: int, units: type) -> DataFrame:
    """(``lang``, ``bucket``, ``key``, ``a``, ``id``) of the frequent units, ranked by frequency."""
    # Written first: dealing by ranges reads its input twice.
    return written(ranked(written(_sums(chunks, least, units), "sums"), "lang", [F.desc("a"), F.asc("key")], "id"), "frequent")


def _with_ids(chunks: DataFrame, frequent: DataFrame, units: type) -> DataFrame:
    # A list per chunk has at most one entry per bucket.
    lists = _ids(chunks, frequent, units).groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("ids"))
    return chunks.where("bucket = -1").select("chunk", "lang", "keys").join(lists, "chunk")


def _places(chunks: DataFrame) -> int:
    """Buckets for the units of ``chunks``: as many as their places ask for."""
    return max(BUCKETS, (chunks.where("bucket = -1").agg(F.sum("size")).first()[0] or 0) // BUCKET_PLACES)


def _lowest_cut(length: int) -> Column:
    """(score, k, l, r) of the cut with the lowest score, the first of equal ones. The products have up to 38 digits."""
    big = lambda c: c.cast("decimal(38,0)")
    cuts = []
    for k in range(1, length):
        l, r = F.element_at("heads", k), F.element_at("tails", length - k)
        over = F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
        under = l.cast("decimal(19,0)") * r.cast("decimal(19,0)")
        cuts.append(F.struct(F.call_function("div", big(over), big(under)).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, words: int = WORDS, top: int = TOP, other: str = NO_LANG) -> DataFrame:
    """(``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``): the first ``top`` phrases of each language.

    Words ``[^\\x20\\x09]+`` stand in pieces between ``[.,;:!?\\x0A-\\x0D]``, A-Z in lower case; a phrase of 2 to ``words`` words that occurs
    ``least`` times or more is a candidate. Its score is the lowest of ``floor(1000 * a * n / (l * r))`` over its cuts. A candidate inside a
    longer one that occurs as often is dropped. Order: score and ``a`` descending, then the phrase by its bytes. Null texts are empty, a null language is
    ``other``, repeated rows count each time, an empty table gives no rows; further columns are not read.

    A text is split once and stands as numbers afterwards, chunk by chunk. Words, then pairs of neighbouring frequent units, are counted within a
    chunk and summed over chunks, tile by tile; the frequent ones are ranked by frequency, and their ranks go back to the chunks that hold
    them. Nothing is broadcast by this code. What is shuffled are the distinct units of each chunk with their counts, packed by bucket: a bucket is read piece by
    piece, and there are as many as the places to count ask for.
    """
    named = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(other)).alias("lang"), text_bytes(text).alias("text"))
    # Words have some five bytes and a blank.
    size = named.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = written(_word_chunks(named, max(BUCKETS, size // 6 // BUCKET_PLACES)), "words")
    totals = written(chunks.where("bucket = -1").groupBy("lang").agg(F.sum("size").alias("n")), "totals")
    kind: type = _Words
    frequent = _frequent(chunks, least, kind)
    once = F.array("a")
    units = frequent.select("lang", "id", F.col("key").alias("phrase"), F.col("key").alias("last"), "a", once.alias("heads"), once.alias("tails"))
    chosen: list[DataFrame] = []
    for length in range(2, words + 1):
        chunks = written(_pair_chunks(_with_ids(chunks, frequent, kind), _places(chunks)), "pairs")
        kind = _Pairs
        frequent = _frequent(chunks, least, kind)
        frequent = frequent.withColumn("left", F.shiftright("key", _RANK_BITS)).withColumn("right", F.col("key").bitwiseAND(F.lit((1 << _RANK_BITS) - 1)))
        first = units.select("lang", F.col("id").alias("left"), F.col("phrase").alias("begin"), "heads")
        second = units.select("lang", F.col("id").alias("right"), "last", "tails")
        longer = frequent.join(first, ["lang", "left"]).join(second, ["lang", "right"])
        longer = longer.select(
            "lang", "id", F.concat("begin", F.lit(b" "), "last").alias("phrase"), "last", "a",
            F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"),
        )
        longer = written(longer, "units")
        if length > 2:
            # A phrase lies in a longer one that is as frequent exactly if it lies in one that is a word longer and as frequent.
            inside = frequent.select("lang", F.col("left").alias("id"), "a").union(frequent.select("lang", F.col("right").alias("id"), "a"))
            most = inside.groupBy("lang", "id").agg(F.max("a").alias("most"))
            chosen.append(units.join(most, ["lang", "id"], "left").where("most IS NULL OR most < a").withColumn("length", F.lit(length - 1)))
        units = longer
    chosen.append(units.withColumn("length", F.lit(words)))
    scored = []
    for found, length in zip(chosen, range(2, words + 1), strict=True):
        cut = found.join(totals, "lang").withColumn("cut", _lowest_cut(length))
        scored.append(cut.select("lang", F.col("phrase").cast("string").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score"))
    every = scored[0]
    for more in scored[1:]:
        every = every.union(more)
    placed = ranked(every, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], "rank").where(F.col("rank") <= top)
    return placed.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
