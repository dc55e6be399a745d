"""Exact substring removal: every byte under a 100-byte string that starts earlier goes.

All 100-byte windows of a corpus cannot be sorted as they are, so they meet in groups: each window has an anchor, the
``GRAM`` bytes with the least hash in it (the first of equal ones). Equal windows have equal anchors at the same offset. The windows of one anchor
place follow each other and make a context. Contexts that are wholly equal need no more than their hashes; of the
others with a common anchor, the bytes are gathered, and their windows are sorted as suffixes: a merge sort whose comparisons
find the common extension by binary search over prefix polynomial hashes. Neighbours that count as equal are verified byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexlake.llm.common import map_batches, small_or_plain, text_bytes
from lexlake.session import written

LENGTH = 100
GRAM = 32
# Documents looked at to find anchors with very many different contexts, and from which number of contexts in them an anchor
# is dealt window by window. Either way gives the same result; the sample only decides how rows are spread.
SAMPLE_DOCS = 50_000
HOT_CONTEXTS = 100
# Windows sorted together in a task.
SORT_WINDOWS = 2_000_000
# Long texts are hashed in parts of this many windows, which overlap by LENGTH - 1 bytes.
PART = 1 << 19

_POS_BITS = 20
_BASE = 0x9E3779B97F4A7C15
_BASE_2 = 0xD6E8FEB86659FD93


class Powers:
    """Powers of an odd base modulo 2^64 and their inverses, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            one, size = np.ones(1, np.uint64), 2 * n
            self.up = np.cumprod(np.concatenate((one, np.full(size, self.base))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate((one, np.full(size, self.inverse))), dtype=np.uint64)
        return self.up, self.down


_FIRST, _SECOND = Powers(_BASE), Powers(_BASE_2)


def mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(_BASE_2)
    return x ^ (x >> np.uint64(32))


def prefix_hashes(data: np.ndarray, powers: Powers) -> np.ndarray:
    up, _ = powers.upto(len(data))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))


def span_hashes(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    return mixed((prefix[end] - prefix[begin]) * powers.upto(len(prefix))[1][begin])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    blocks = np.concatenate((x, np.full((-n) % width, np.uint64(0xFFFFFFFFFFFFFFFF)))).reshape(-1, width)
    after = np.minimum.accumulate(blocks, axis=1).ravel()
    before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(before[: n - width + 1], after[width - 1 : n])


def contexts(text: bytes) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window, windows, anchor offset) of each context of a text, in order."""
    parts = []
    reach = LENGTH - GRAM + 1
    for base in range(0, max(0, len(text) - LENGTH + 1), PART):
        data = np.frombuffer(text, np.uint8, min(PART + LENGTH - 1, len(text) - base), base)
        prefix = prefix_hashes(data, _FIRST)
        n = len(data)
        grams = mixed((prefix[GRAM:] - prefix[: n - GRAM + 1]) * _FIRST.upto(n)[1][: n - GRAM + 1])
        keyed = (grams >> np.uint64(_POS_BITS) << np.uint64(_POS_BITS)) | np.arange(len(grams), dtype=np.uint64)
        least = _sliding_min(keyed, reach)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        end = np.concatenate((first[1:], [len(least)]))
        anchor = (least[first] & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
        second = prefix_hashes(data, _SECOND)
        # Extent and offset belong to a context as much as its bytes do.
        shape = ((end - first) * LENGTH + (anchor - first)).astype(np.uint64) * np.uint64(_BASE)
        whole = span_hashes(second, first, end - 1 + LENGTH, _SECOND) ^ mixed(shape)
        parts.append((grams[anchor], whole, first + base, end - first, anchor - first))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _window_rows(text: bytes, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """The windows of contexts one by one: (hash, second hash, place)."""
    places = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    data = np.frombuffer(text, np.uint8)
    found = [span_hashes(prefix_hashes(data, p), places, places + LENGTH, p) for p in (_FIRST, _SECOND)]
    return found[0], found[1], places


def pack(place: np.ndarray, offset: np.ndarray, count: np.ndarray, local: np.ndarray) -> np.ndarray:
    return (place << 15) | (offset << 8) | (count << 1) | local


def _anchor_rows(named: DataFrame, hot: set[int]) -> DataFrame:
    """(k1, k2, doc_id, h, packed) of every context, or of every window where the anchor is hot.

    Of equal rows in a batch only the earliest keeps its keys; the others are known to come later, so they are
    marked and get keys of their own, which spreads them. A key thus has at most one row per batch and context.
    """
    hot_keys = np.array(sorted(hot), np.uint64)
    schema = "k1 long, k2 long, doc_id long, h long, packed long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, salts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                k1, k2, place, count, offset = contexts(text)
                if len(hot_keys) and len(k1):
                    near = np.minimum(np.searchsorted(hot_keys, k1), len(hot_keys) - 1)
                    at = hot_keys[near] == k1
                    if at.any():
                        w1, w2, where = _window_rows(text, place[at], count[at])
                        zero = np.zeros(len(where), np.int64)
                        k1, k2 = np.concatenate((k1[~at], w1)), np.concatenate((k2[~at], w2))
                        place, count = np.concatenate((place[~at], where)), np.concatenate((count[~at], zero + 1))
                        offset = np.concatenate((offset[~at], zero))
                rows.append((k1, k2, np.full(len(k1), i), place, count, offset))
            k1, k2, doc, place, count, offset = (np.concatenate(x) for x in zip(*rows, strict=True))
            doc_id, h = ids[doc], salts[doc]
            order = np.lexsort((place, h, doc_id, k2, k1))
            a, b = k1[order], k2[order]
            later = np.zeros(len(order), bool)
            later[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            local = np.zeros(len(order), bool)
            local[order] = later
            packed = pack(place, offset, count, local.astype(np.int64))
            own = mixed(doc_id.astype(np.uint64) * np.uint64(_BASE) + packed.astype(np.uint64))
            k1 = np.where(local, own, k1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(doc_id), pa.array(h), pa.array(packed)],
                ["k1", "k2", "doc_id", "h", "packed"],
            )

    return map_batches(named, work, schema)


# ---- hash-compared suffix sort ----


class Suffixes:
    """Windows of a byte buffer, compared by prefix polynomial hashes."""

    def __init__(self, data: np.ndarray, length: int = LENGTH) -> None:
        self.data, self.length = data, length
        self.prefix = prefix_hashes(data, _FIRST)
        self.up = _FIRST.upto(len(data))[0]

    def _equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        p, up = self.prefix, self.up
        return (p[a + length] - p[a]) * up[b] == (p[b + length] - p[b]) * up[a]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of the windows at ``a`` and ``b``: binary search over its length."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length, np.int64)
        whole = self._equal(a, b, high)
        low[whole] = self.length
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) // 2
            same = self._equal(a[open_], b[open_], middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether window ``a`` sorts before ``b``."""
        common = self.common(a, b)
        whole = common == self.length
        inner = np.where(whole, 0, common)
        return np.where(whole, or_equal, self.data[a + inner] < self.data[b + inner])

    def merge_sort(self, at: np.ndarray, family: np.ndarray) -> np.ndarray:
        """Order of the windows ``at`` inside each family (ascending runs of equal ``family``); stable.

        All runs of one width are merged together: the new place of a window is its place in its own run
        plus the number of windows of the neighbouring run that go before it, found by binary search.
        """
        order = np.arange(len(at))
        begin = np.flatnonzero(np.concatenate(([True], family[1:] != family[:-1])))
        size = np.diff(np.concatenate((begin, [len(at)])))
        head, total = np.repeat(begin, size), np.repeat(size, size)
        place = np.arange(len(at)) - head
        width = 1
        while width < size.max(initial=0):
            run = place // width
            right = run % 2 == 1
            other = np.where(right, run - 1, run + 1) * width
            many = np.clip(total - other, 0, width)
            low, high = np.zeros(len(at), np.int64), many.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                mine = at[order[open_]]
                theirs = at[order[head[open_] + other[open_] + middle]]
                goes = np.empty(len(open_), bool)
                is_right = right[open_]
                # Equal windows of the left run stay before those of the right run.
                goes[is_right] = self.before(theirs[is_right], mine[is_right], True)
                goes[~is_right] = self.before(theirs[~is_right], mine[~is_right], False)
                low[open_[goes]] = middle[goes] + 1
                high[open_[~goes]] = middle[~goes]
            moved = head + (run // 2) * 2 * width + place % width + low
            fresh = np.empty_like(order)
            fresh[moved] = order
            order = fresh
            width *= 2
        return order


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.ones(len(a), bool)
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    for at in range(0, len(a), 1 << 17):
        part = slice(at, at + (1 << 17))
        out[part] = (view[a[part]] == view[b[part]]).all(axis=1)
    return out


def later_windows(texts: list[bytes], group: np.ndarray, offset: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of all windows that equal one of an earlier context, or an earlier one, of their group.

    ``rank`` orders the contexts by document and place; ``offset`` is that of the anchor from the first window.
    """
    counts = np.array([len(t) for t in texts], np.int64) - LENGTH + 1
    data = np.frombuffer(b"".join(texts), np.uint8)
    base = np.concatenate(([0], np.cumsum(counts + LENGTH - 1)[:-1]))
    ctx = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(ctx)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = base[ctx] + within
    suffixes = Suffixes(data)
    # A window whose hash stands alone in its group equals no other.
    hashes = span_hashes(suffixes.prefix, at, at + LENGTH, _FIRST) ^ mixed(group[ctx].astype(np.uint64) * np.uint64(_BASE_2))
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    several = np.zeros(len(order), bool)
    several[order[1:][same]] = several[order[:-1][same]] = True
    keep = np.flatnonzero(several)
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ctx, within, at = ctx[keep], within[keep], at[keep]
    # Equal windows have their anchor at the same offset, so only such windows are compared.
    family = group[ctx] * (2 * LENGTH) + (offset[ctx] - within + LENGTH)
    start = np.lexsort((within, rank[ctx], family))
    ctx, within, at, family = ctx[start], within[start], at[start], family[start]
    order = suffixes.merge_sort(at, family)
    ctx, within, at, family = ctx[order], within[order], at[order], family[order]
    near = np.flatnonzero((family[1:] == family[:-1]) & suffixes._equal(at[1:], at[:-1], np.full(len(at) - 1, LENGTH)))
    verified = _same_bytes(data, at[near + 1], at[near])
    later = np.zeros(len(at), bool)
    later[near + 1] = verified
    if not verified.all():  # a hash collision: take the families it is in by their bytes
        for f in np.unique(family[near[~verified] + 1]).tolist():
            rows = np.flatnonzero(family == f)
            seen: set[bytes] = set()
            for r in sorted(rows.tolist(), key=lambda r: (rank[ctx[r]], within[r])):
                window = data[at[r] : at[r] + LENGTH].tobytes()
                later[r] = window in seen
                seen.add(window)
    return ctx[later], within[later]


def _later_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, h, start, end) of what later windows cover; ``rows`` (k1, doc_id, h, place, offset, bytes) come sorted by k1."""
    span = "doc_id long, h long, start long, end long"

    def solve(table: pa.Table) -> pa.RecordBatch | None:
        texts = table.column("bytes").to_pylist()
        k1, ids, salts, place, offset = (table.column(c).to_numpy() for c in ("k1", "doc_id", "h", "place", "offset"))
        group = np.cumsum(np.concatenate(([0], k1[1:] != k1[:-1])))
        rank = np.empty(len(k1), np.int64)
        rank[np.lexsort((place, salts, ids))] = np.arange(len(k1))
        ctx, window = later_windows(texts, group, offset, rank)
        if not len(ctx):
            return None
        order = np.lexsort((window, ctx))
        ctx, window = ctx[order], window[order]
        fresh = np.concatenate(([True], (ctx[1:] != ctx[:-1]) | (window[1:] != window[:-1] + 1)))
        head = np.flatnonzero(fresh)
        tail = np.concatenate((head[1:], [len(ctx)])) - 1
        c = ctx[head]
        arrays = [ids[c], salts[c], place[c] + window[head], place[c] + window[tail] + LENGTH]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["doc_id", "h", "start", "end"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            waiting += batch.num_rows * (LENGTH - GRAM + 1) // 2
            if waiting < SORT_WINDOWS:
                continue
            table = pa.Table.from_batches(held)
            k1 = table.column("k1").to_numpy()
            cut = int(np.searchsorted(k1, k1[-1]))  # the last group may go on
            if cut:
                found = solve(table.slice(0, cut))
                if found is not None:
                    yield found
            held = table.slice(cut).to_batches()
            waiting = (len(k1) - cut) * (LENGTH - GRAM + 1) // 2
        if held:
            found = solve(pa.Table.from_batches(held))
            if found is not None:
                yield found

    return map_batches(rows, work, span)


def _hot_anchors(named: DataFrame, rows: int) -> set[int]:
    """Anchors with ``HOT_CONTEXTS`` or more contexts in a sample of documents: fewer than the sample's contexts / ``HOT_CONTEXTS``."""
    share = min(1.0, SAMPLE_DOCS / max(rows, 1))
    sample = named.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    found = _anchor_rows(sample, set()).where("packed % 2 = 0").select("k1", "k2").distinct()
    return {r["k1"] & 0xFFFFFFFFFFFFFFFF for r in found.groupBy("k1").count().where(F.col("count") >= HOT_CONTEXTS).select("k1").collect()}


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``n_bytes``, ``spans``, ``kept``) of every row: ``spans`` are the removed runs (start, end) in bytes, ``kept`` the rest.

    A byte is removed where a window of ``LENGTH`` bytes over it stands earlier: in a smaller id, or before in its own
    text. Windows do not cross texts. A null text is empty. A null id comes first. Rows of one id are ordered by
    the hash of their text, and rows equal in id and text are one document that is returned as often as it comes.
    """
    total, ids = docs.agg(F.count(F.lit(1)), F.count_distinct(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(2**63))))).first()
    salt = F.lit(0).cast("long") if total == ids else F.xxhash64("text")
    # The least long stands for null in between.
    named = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(2**63))).alias("doc_id"), text_bytes(text).alias("text"))
    named = named.select("doc_id", salt.alias("h"), "text")
    unique = named if total == ids else named.dropDuplicates(["doc_id", "h"])

    rows = _anchor_rows(unique, _hot_anchors(unique, total))
    by_key = Window.partitionBy("k1")
    marked = rows.select(
        "*",
        F.lag("k2").over(by_key.orderBy("k2", "doc_id", "h", "packed")).alias("previous"),
        (F.min("k2").over(by_key) != F.max("k2").over(by_key)).alias("several"),
    )
    local = F.col("packed") % 2 == 1
    later = local | F.coalesce(F.col("previous") == F.col("k2"), F.lit(False))
    found = written(
        marked.withColumn("later", later).where("later OR several").select("k1", "doc_id", "h", "packed", "later"), "contexts"
    )
    place = F.shiftright("packed", 15)
    count = F.shiftright("packed", 1).bitwiseAND(F.lit(127))
    whole = found.where("later").select("doc_id", "h", place.alias("start"), (place + count + LENGTH - 1).alias("end"))

    open_ = found.where("NOT later").groupBy("doc_id", "h").agg(F.collect_list(F.struct("k1", "packed")).alias("contexts"))
    wanted = written(open_, "open")
    side = small_or_plain(wanted, found.where("NOT later").count())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_, salts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts, lists = batch.column(2).to_pylist(), batch.column(3)
            many = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            k1, packed = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            doc = np.repeat(np.arange(len(many)), many)
            start, size = packed >> 15, (packed >> 1) & 127
            cuts = [texts[d][a : a + n + LENGTH - 1] for d, a, n in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
            arrays = [k1, ids_[doc], salts[doc], start, (packed >> 8) & 127]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in arrays), pa.array(cuts, pa.binary())], ["k1", "doc_id", "h", "place", "offset", "bytes"])

    texts = map_batches(unique.join(side, ["doc_id", "h"]).select("doc_id", "h", "text", "contexts"), cut, "k1 long, doc_id long, h long, place long, offset long, bytes binary")
    partly = _later_spans(texts.repartition("k1").sortWithinPartitions("k1"))

    spans = written(whole.unionByName(partly).groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "end")).alias("runs")), "runs")
    n = spans.agg(F.sum(F.size("runs"))).first()[0] or 0
    joined = named.join(small_or_plain(spans, n), ["doc_id", "h"], "left").select("doc_id", "text", "runs")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, merged, kept = [], [], []
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            start, end = lists.values.field(0).to_numpy(), lists.values.field(1).to_numpy()
            for i, text in enumerate(batch.column(1).to_pylist()):
                sizes.append(len(text))
                a, b = start[offsets[i] : offsets[i + 1]], end[offsets[i] : offsets[i + 1]]
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                fresh = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1]))) if len(a) else np.zeros(0, np.int64)
                a, b = a[fresh].tolist(), b[np.concatenate((fresh[1:] - 1, [len(b) - 1]))].tolist() if len(fresh) else []
                merged.append([{"start": x, "end": y} for x, y in zip(a, b, strict=True)])
                edges = [0, *(e for pair in zip(a, b, strict=True) for e in pair), len(text)]
                kept.append(b"".join(text[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2)))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(merged, span), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    done = map_batches(joined, apply, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63))))
