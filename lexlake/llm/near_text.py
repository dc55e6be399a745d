"""Near copies by text: SimHash fingerprints in a Gray-order index, then MinHash bands over the same word shingles, find candidates; the exact
Jaccard similarity of their shingles decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import blank_words, heads_only, map_batches, small_or_plain, text_bytes
from lexlake.llm.components import connected_components
from lexlake.llm.simhash import link_fingerprints, majority
from lexlake.session import written

SHINGLE = 5
SIMILARITY = 0.8
# At similarity 0.8 a pair shares none of 40 bands of six least hashes once in 190,000 times.
BANDS, BAND_ROWS = 40, 6
# Pairs whose 240 one-bit least hashes differ in more bits are not compared; at similarity 0.8, 24 are expected, and 48 are 5 deviations more.
SKETCH_BITS = 48
# Rounds in which each bucket is compared with one member only; they settle large groups before pairs are listed.
STARS = 2

_RANDOM = np.random.default_rng(20240501)
_FLIP = _RANDOM.integers(0, 2**32, BANDS * BAND_ROWS, dtype=np.uint32)
_TIMES = _RANDOM.integers(0, 2**32, BANDS * BAND_ROWS, dtype=np.uint32) | np.uint32(1)
_BIT = _RANDOM.integers(0, 2**32, BANDS * BAND_ROWS, dtype=np.uint32) | np.uint32(1)
_MIX = _RANDOM.integers(0, 2**63, (BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)
_BAND = _RANDOM.integers(0, 2**63, BANDS, dtype=np.uint64)
_BASE, _SPREAD = (int(x) | 1 for x in _RANDOM.integers(2**62, 2**63, 2))
# Shingles whose least hashes are taken at once: 256 rows of 240 four-byte values stay in a core's cache.
SHINGLE_BLOCK = 256


def node_of(text: bytes) -> int:
    """64-bit hash of the lower-cased words: texts that differ in blanks or case only are one node."""
    return xxhash.xxh3_64_intdigest(b" ".join(blank_words(text, lower=True)))


def every_shingle(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all word shingles, repeats included; a shorter text is one shingle, one without words has none.

    Words are hashed by XXH64, and a shingle is the polynomial of its words, mixed.
    """
    words = blank_words(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(words))
    rows = len(words) - size + 1
    total = np.zeros(rows, np.uint64)
    for i in range(size):
        total = total * np.uint64(_BASE) + each[i : i + rows]
    total = (total ^ (total >> np.uint64(32))) * np.uint64(_SPREAD)
    return total ^ (total >> np.uint64(29))


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of all word shingles, ascending."""
    return np.unique(every_shingle(text, shingle))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, 256 bits as four longs) of the least hashes, which have 32 bits: equal ones stay equal, a chance match only adds a candidate."""
    least = np.full(len(_FLIP), np.uint32(0xFFFFFFFF))
    short = hashes.astype(np.uint32)
    for at in range(0, len(short), SHINGLE_BLOCK):
        np.minimum(least, ((short[at : at + SHINGLE_BLOCK, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    keys = (least.reshape(BANDS, BAND_ROWS).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND
    bits = np.zeros(256, np.uint8)
    bits[: len(least)] = (least * _BIT) >> np.uint32(31)
    return keys, np.packbits(bits).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(``doc_id``, ``node``, ``fp``, ``keys``, ``bits``) of (``doc_id``, ``text``); no keys without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, codes, keys, bits = [], [], [], []
            for text in batch.column(1).to_pylist():
                nodes.append(node_of(text))
                every = every_shingle(text, shingle)
                codes.append(majority(every))
                k, b = sketch(np.unique(every))
                keys.append(k.view(np.int64).tolist() if len(every) else [])
                bits.append(b.tolist())
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, codes)]
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, *lists], ["doc_id", "node", "fp", "keys", "bits"])

    return map_batches(docs, work, "doc_id long, node long, fp long, keys array<long>, bits array<long>")


def _shingle_sets(nodes: DataFrame, codes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(``node``, ``hashes``) of written ``nodes``: their distinct shingle hashes. Only the documents of these are read again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = np.array([node_of(t) for t in texts], np.uint64).view(np.int64)
            sets = pa.array([shingle_hashes(t, shingle).view(np.int64) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(found), sets], ["node", "hashes"])

    n = nodes.count()
    side = small_or_plain(nodes, n)
    ids = small_or_plain(written(codes.join(side, "node", "left_semi").select(F.col("least").alias("doc_id")).distinct(), "ids"), n)
    # An id may be repeated over other texts, and a text over rows of that id.
    sets = map_batches(docs.join(ids, "doc_id", "left_semi"), work, "node long, hashes array<long>")
    return written(sets.join(side, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return written(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "compared")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v, similar) of written pairs, by the written ``sets`` of their nodes."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(2), batch.column(3), strict=True)
            found = [similarity(*(x.values.to_numpy().view(np.uint64) for x in s)) >= least for s in sides]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_())], ["u", "v", "similar"])

    return written(map_batches(both.select("u", "v", "a", "b"), work, "u long, v long, similar boolean"), "verified")


def _fingerprint_pairs(codes: DataFrame) -> DataFrame:
    """(u, v) of nodes: those of one fingerprint, and those whose fingerprints the Gray-order index links, each by the least node of its fingerprint."""
    worded = codes.where(F.size("keys") > 0)
    heads = written(worded.groupBy("fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")), "fingerprints")
    links = link_fingerprints(heads.select("fp"))
    head = lambda fp, name: heads.select(F.col("fp").alias(fp), F.col("head").alias(name))
    near = links.join(head("u", "a"), "u").join(head("v", "b"), "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    same = worded.join(heads.where("n > 1").select("fp", "head"), "fp").where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    return near.union(same).distinct()


def _prefix_pairs(placed: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(u, v) of all nodes of ``placed`` (``node``, ``root``) with unlike roots that can have a similarity of ``least`` or more; nothing is lost.

    The shingles of each set are put in one order, the rarest first. Two sets of a similarity of ``least`` have ``least / (1 + least)`` of
    their sizes' sum in common, so the first common shingle stands so early in both that as many can follow; a set is known by that beginning, and
    what only edited texts have is in it. Rows meet by a shingle of their beginnings only.
    """
    each = sets.select("node", F.size("hashes").alias("size"), F.explode("hashes").alias("hash"))
    counts = each.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.join(counts, "hash").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "hash"))).alias("l"))
    # Other sets have at least ``least`` of the size, and with that much in common the last place to begin is here; the margin is for rounding.
    begin = F.least(F.floor(F.col("size") * F.lit(1 - least) + 1e-6) + 1, F.col("size")).cast("int")
    cut = ranked.select("node", "size", F.posexplode(F.slice("l", F.lit(1), begin)).alias("at", "t")).where("t.n > 1")
    known = written(cut.select("node", "size", "at", F.col("t.hash").alias("hash")).join(placed, "node"), "beginnings")
    # One side of any pair of unlike roots lies outside of the root that a shingle has most often.
    often = known.groupBy("hash", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("hash")
    most = written(often.agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("hash", "main"), "mixed")
    side = small_or_plain(most, most.count())
    here = known.join(side, "hash")
    x, y = here.drop("main").alias("x"), here.where("root <> main").drop("main").alias("y")
    common = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    enough = common + 1e-6 >= F.lit(least / (1 + least)) * (F.col("x.size") + F.col("y.size"))
    met = x.join(y, (F.col("x.hash") == F.col("y.hash")) & (F.col("x.root") != F.col("y.root")) & enough)
    return met.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).distinct()


def _joined_roots(roots: DataFrame, side: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (``side``: the same, hinted) after ``links`` (u, v): only roots and new nodes that a link touches go through the components again."""
    of = lambda name: side.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    ends = links.join(of("u"), "u", "left").join(of("v"), "v", "left")
    moved = written(connected_components(ends.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))), "moved")
    # A root is a node of its own component, so a root that moves stands in both tables with the same row.
    before = roots.union(moved.select("node", F.col("node").alias("root"))).distinct()
    to = small_or_plain(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), moved.count())
    return written(before.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")


def near_text_roots(docs: DataFrame, codes: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """(``node``, ``root``) of all nodes linked to others: components over pairs of candidates at or above ``least``.

    ``codes`` has one row per node (``node``, ``least``, ``fp``, ``keys``, ``bits``). The links of the Gray-order index over the fingerprints come first: they hold
    the copies and what is nearly unchanged. Two bits of 64 miss most pairs at the bound, so nodes that share a band are candidates as well. A bucket is compared with
    one member of its largest component; once its members are of one component, no further pair of it can change anything. After ``STARS`` rounds
    the members of the buckets that are still mixed are compared wherever the rare shingles of unlike components allow for ``least``, so the components are those of all candidate pairs.
    """
    spark = docs.sparkSession
    pairs = written(_fingerprint_pairs(codes), "pairs")
    done = _verified(pairs, _shingle_sets(_ends(pairs), codes, docs, shingle), least)
    roots = spark.createDataFrame([], "node long, root long")
    roots = _joined_roots(roots, small_or_plain(roots, 0), done.where("similar"))
    dealt = codes.select("node", "bits", F.explode("keys").alias("key"))
    shared = written(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared")
    members = written(dealt.join(small_or_plain(shared, shared.count()), "key", "left_semi"), "members")
    apart = lambda a, b: sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(4)), F.lit(0)) <= SKETCH_BITS
    for turn in range(STARS + 1):
        side = small_or_plain(roots, roots.count())
        now = members.join(side, "node", "left").withColumn("root", F.coalesce("root", "node"))
        first = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "bits")).alias("head")
        per_root = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), first)
        largest = F.max(F.struct("n", "root", "head.node", "head.bits")).alias("m")
        mixed = written(per_root.groupBy("key").agg(largest, F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key", "m.root", "m.node", "m.bits"), "mixed")
        n = mixed.count()
        if not n:
            break
        other = small_or_plain(mixed, n)
        if turn == STARS:
            open_ = written(now.join(other.select("key"), "key", "left_semi").select("node", "root").distinct(), "open")
            sets = _shingle_sets(open_.select("node"), codes, docs, shingle)
            pairs = _prefix_pairs(open_, sets, least)
        else:
            met = now.alias("x").join(other.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & apart("x", "y"))
            pairs = met.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).distinct()
        pairs = written(pairs.join(done.select("u", "v"), ["u", "v"], "left_anti"), "pairs")
        if turn < STARS:
            sets = _shingle_sets(_ends(pairs), codes, docs, shingle)
        found = _verified(pairs, sets, least)
        done = done.union(found)
        roots = _joined_roots(roots, side, found.where("similar"))
    return roots


def drop_near_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """One row of each component of texts whose distinct word shingles have a Jaccard similarity of ``least`` or more: a row of its least id.

    Blanks and ASCII case do not count. Texts without words are equal. An id may be repeated over unlike texts: each component keeps a row. Rows
    without an id stay and link nothing. The columns are those of ``docs``.
    """
    named = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_bytes(text).alias("text")).where("doc_id IS NOT NULL")
    found = written(_sketches(named, shingle), "sketches")
    codes = written(found.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), "codes")
    roots = near_text_roots(named, codes, shingle, least)
    rooted = codes.select("node", "least").join(small_or_plain(roots, roots.count()), "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = written(rooted.groupBy("root").agg(F.min(F.struct(F.col("least").alias("doc_id"), "node")).alias("h")).select("h.*"), "first")
    own = found.select("doc_id", "node").join(small_or_plain(heads, heads.count()), ["doc_id", "node"], "left_semi")
    times = own.groupBy("doc_id", F.col("node").alias("code")).agg(F.count(F.lit(1)).alias("times"))
    return heads_only(docs, written(times, "heads"), key, text, node_of)
