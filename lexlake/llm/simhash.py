"""SimHash near copies: fingerprints, a Gray-order hierarchical index, and components of the links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import blank_words, heads_only, map_batches, small_or_plain, text_bytes
from lexlake.llm.components import connected_components
from lexlake.session import written

SHINGLE = 3
DISTANCE = 2
SEED = 42
# Members of an index node.
FANOUT = 16
# A bucket with more distinct fingerprints than this is dealt again by the bits that its key leaves open.
HOT_BUCKET = 50_000
# Queries that walk an index at a time.
STEP = 2048


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits over the XXH64 of all word shingles, repeats included; 0 without words."""
    words = blank_words(text, lower=True)
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, SEED)
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return majority(np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    major = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(major.view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(``doc_id``, ``fp``) of every row; ``fp`` holds the 64 bits as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    named = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return map_batches(named, work, "doc_id long, fp long")


# ---- the index ----


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence: neighbours in that order differ by one bit."""
    rank = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy over codes in Gray order, several groups side by side.

    A node holds the bits on which all codes below it agree: ``mask`` and ``bits``. What an
    upper node holds is taken out of the nodes below, so the differences of a path add up to those of the code,
    and a branch ends as soon as they exceed the distance.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray) -> None:
        order = np.lexsort((gray_rank(codes), group))
        self.order = order
        self.codes, self.group = codes[order], group[order]
        every = np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF))
        levels = [(self.codes, every, self.group, None, None)]
        while True:
            bits, mask, owner = levels[-1][:3]
            first = np.concatenate(([True], owner[1:] != owner[:-1]))
            begin = np.flatnonzero(first)
            within = np.arange(len(owner)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(owner)]))))
            if len(levels) > 1 and not within.any():
                break
            heads = np.flatnonzero(within % FANOUT == 0)
            both = np.bitwise_and.reduceat(bits & mask, heads)
            some = np.bitwise_or.reduceat(bits & mask, heads)
            shared = np.bitwise_and.reduceat(mask, heads) & ~(some ^ both)
            counts = np.diff(np.concatenate((heads, [len(owner)])))
            levels.append((both & shared, shared, owner[heads], heads, counts))
        # Factor: a node keeps only the bits that its parent does not hold.
        self.levels = []
        for depth, (bits, mask, owner, heads, counts) in enumerate(levels):
            own = mask
            if depth + 1 < len(levels):
                own = mask & ~np.repeat(levels[depth + 1][1], levels[depth + 1][4])
            self.levels.append((bits, own, owner, heads, counts))

    def links(self, at: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, other) of sorted places in one group within ``distance``, for the places ``at``."""
        top = self.levels[-1]
        query = at
        node = np.searchsorted(top[2], self.group[at])
        spent = np.zeros(len(at), np.int16)
        for depth in range(len(self.levels) - 1, -1, -1):
            bits, own, _, heads, counts = self.levels[depth]
            spent = spent + popcount((self.codes[query] ^ bits[node]) & own[node])
            live = spent <= distance
            query, node, spent = query[live], node[live], spent[live]
            if depth:
                many = counts[node]
                offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                query, spent = np.repeat(query, many), np.repeat(spent, many)
                node = np.repeat(heads[node], many) + offset
        return query, node


def forest(n: int, left: np.ndarray, right: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least member of each component as far as the links say, going on from ``label``."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[left], label[right]
        low = np.minimum(a, b)
        if np.array_equal(a, b):
            return label
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped


def group_edges(codes: np.ndarray, group: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within ``distance`` inside a group: each code to the first of its component.

    A code has at most 2,081 others within two bits, so the pairs of one step are bounded; they are
    folded into the forest and never handed out.
    """
    index = GrayIndex(codes, group)
    label = np.arange(len(codes))
    for begin in range(0, len(codes), STEP):
        query, other = index.links(np.arange(begin, min(begin + STEP, len(codes))), distance)
        apart = other < query
        label = forest(len(codes), query[apart], other[apart], label)
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return index.codes[moved], index.codes[label[moved]]


def _block_key(code: Column, width: int, pair: tuple[int, int]) -> Column:
    one = lambda b: F.shiftrightunsigned(code, b * width).bitwiseAND(F.lit((1 << width) - 1))
    return F.shiftleft(one(pair[0]), width).bitwiseOR(one(pair[1]))


def link_fingerprints(codes: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """(u, v) that connect all distinct fingerprints ``fp`` linked within two bits.

    Two codes with two differing bits agree on two of four 16-bit blocks. Each code goes to
    the six buckets of its block pairs, and each bucket is searched through its own index. A bucket above ``hot``
    members is dealt again by two of the four 8-bit blocks of the other 32 bits, which leaves 16 bits open: such a bucket has at
    most 65,536 members however large the input is.
    """
    pairs = list(combinations(range(4), 2))
    fp = F.col("fp")
    keys = [
        F.struct(
            F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(_block_key(fp, 16, p)).alias("key"),
            # The 32 bits that the key leaves open.
            _block_key(fp, 16, tuple(b for b in range(4) if b not in p)).alias("open"),
        )
        for n, p in enumerate(pairs)
    ]
    dealt = codes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.key", "k.open")
    crowded = written(dealt.groupBy("key").count().where(F.col("count") > hot).select("key"), "crowded")
    n = crowded.count()
    if n:
        marked = dealt.join(small_or_plain(crowded.withColumn("crowded", F.lit(True)), n), "key", "left")
        subs = [
            F.shiftleft(F.lit(i + 1).cast("long"), 16).bitwiseOR(_block_key(F.col("open"), 8, p)) for i, p in enumerate(pairs)
        ]
        sub = F.when(F.col("crowded"), F.array(*subs)).otherwise(F.array(F.lit(0).cast("long")))
        dealt = marked.select("fp", "key", F.explode(sub).alias("sub"))
    else:
        dealt = dealt.select("fp", "key", F.lit(0).cast("long").alias("sub"))
    buckets = dealt.groupBy("key", "sub").agg(F.collect_list("fp").alias("codes")).where(F.size("codes") > 1).select("codes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            begin = lists.offsets[0].as_py()
            flat = lists.values.to_numpy(zero_copy_only=False)[begin : begin + sizes.sum()].view(np.uint64)
            # Buckets are searched side by side, about HOT_BUCKET codes at a time.
            cut = np.flatnonzero(np.diff(np.cumsum(sizes) // hot)) + 1
            for rows in np.split(np.arange(len(sizes)), cut):
                if not len(rows):
                    continue
                offset = int(sizes[: rows[0]].sum())
                part = flat[offset : offset + int(sizes[rows].sum())]
                u, v = group_edges(part, np.repeat(np.arange(len(rows)), sizes[rows]))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return map_batches(buckets, work, "u long, v long")


def _rooted(docs: DataFrame, key: str, text: str, shingle: int, hot: int) -> DataFrame:
    """(``doc_id``, ``fp``, ``component_id``, ``root``) of every row; ``root`` is a fingerprint that only one component has."""
    found = written(fingerprints(docs, key, text, shingle), "fingerprints")
    codes = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    roots = written(connected_components(link_fingerprints(codes.select("fp"), hot)), "roots")
    n = roots.count()
    linked = codes.join(small_or_plain(roots, n), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(linked.select("fp", "root").join(ids, "root").select("fp", "component_id", "root"), "components")
    return found.join(small_or_plain(named, named.count()), "fp", "left").select("doc_id", "fp", "component_id", "root")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, hot: int = HOT_BUCKET) -> DataFrame:
    """(``doc_id``, ``fp``, ``component_id``) of every row: the least id reachable over links of two bits or fewer.

    Null or blank texts have fingerprint 0 and link like any other; equal texts have equal fingerprints and are compared once. Rows
    with a null id keep their fingerprint and get the component of their code (null if no row of it has an id); repeated rows stay.
    """
    return _rooted(docs, key, text, shingle, hot).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each component: a row of its least id.

    Components are told apart by fingerprint, so an id may be repeated over unlike texts and each keeps its row. Of rows with that id
    in one component the least fingerprint and then the least text stays. Rows without an id cannot be told apart and stay. The columns are those of ``docs``.
    """
    own = _rooted(docs, key, text, shingle, HOT_BUCKET).where("doc_id = component_id")
    per = own.groupBy("root", "doc_id", "fp").agg(F.count(F.lit(1)).alias("times"))
    least = per.groupBy("root").agg(F.min(F.struct("doc_id", F.col("fp").alias("code"), "times")).alias("h"))
    return heads_only(docs, written(least.select("h.*"), "heads"), key, text, partial(fingerprint, shingle=shingle))
