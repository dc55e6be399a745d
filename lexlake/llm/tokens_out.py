"""Token-ID output: Parquet list columns in doc_id order, read back as offsets and checksums."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexlake.llm.common import Memory, map_batches
from lexlake.session import scratch_path

END_ID = 1
# Words, and parts of a text (between ASCII blanks) that are more than a word and marks, whose ids a worker keeps in each
# generation of its memory, and the longest ones that it keeps, in characters.
CACHE_WORDS = 500_000
CACHE_PARTS = 100_000
CACHE_CHARS = 40
# What a worker keeps of these beyond a task at most; some 30 MB.
KEPT_ENTRIES = 150_000
# Parts that go through the library in one call, and bytes of text that are taken apart at a time.
TOGETHER = 5000
CHUNK_BYTES = 8 << 20
# Writer settings: format v2 pages give delta encoding where a dictionary does not pay, small
# row groups and pages with column indexes allow reading few documents, ids and metadata are separate columns.
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "5000",
}

# The normalizer and the pre-tokenizer of the word tokenizer's file, for which ``Encoder`` takes texts apart.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

# Letters, each of them one code point that composes with nothing before it and has one lower-case letter.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
# Such letters and the ASCII marks that end a word as one token string of their own.
_WORD_AND_TAIL = rf"^(?P<word>[{_LETTERS}]+)(?P<tail>[.,;:!?#$%&*|]*)$"


def _gather(flat: np.ndarray, sizes: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked runs of ``flat``, which is cut into runs of ``sizes``, one after another, and where each of them ends."""
    n = sizes[picked]
    ends = np.cumsum(n)
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(before[picked] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


class Encoder:
    """Ids of texts through the tokenizers library, with a bounded memory of the ids of what stands between ASCII blanks.

    The tokenizer of the file replaces blanks and splits at them, so these parts are encoded by themselves, each
    distinct part of a chunk once. It also splits between letters and marks: a word of ``_LETTERS`` followed by marks is
    the ids of both. To such a word, the steps before the merges only change letters to lower case and to the byte
    letters of the library, so both are done to many words at once and the words go to the model of the tokenizer directly. A file
    with other rules than ``NORMALIZER`` and ``PRE_TOKENIZER`` is used through the library alone, text by text.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x180)}
        self.parts, self.words = Memory(CACHE_PARTS), Memory(CACHE_WORDS)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        # Only these rules allow taking texts apart here; under any others the library gets whole texts.
        self.by_parts = (rules["normalizer"], rules["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)

    def forget(self, words: int = 0) -> None:
        """Empty the memories if they hold more than so many entries."""
        if sum(len(m.young) + len(m.old) for m in (self.words, self.parts)) > words:
            self.parts.forget()
            self.words.forget()

    def _by_library(self, parts: list[str]) -> list[bytes]:
        encode = self.tokenizer.encode_batch_fast
        groups = (parts[at : at + TOGETHER] for at in range(0, len(parts), TOGETHER))
        return [np.array(e.ids, "<u4").tobytes() for g in groups for e in encode(g, add_special_tokens=False)]

    def _by_model(self, words: list[str]) -> list[bytes]:
        pieces, letters = self.tokenizer.model.tokenize, self.byte_letters
        ids = [[t.id for t in pieces(w if w.isascii() else w.translate(letters))] for w in words]
        ends = np.cumsum([4 * len(x) for x in ids], dtype=np.int64).tolist()
        data = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        return list(map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)))

    @staticmethod
    def _known(memory: Memory, keys: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of distinct ``keys``: of those that the memory lacks by ``encode``."""
        found = list(map(memory.young.get, keys))
        if None in found:
            asked = {k: memory.old.get(k) for k, ids in zip(keys, found, strict=True) if ids is None}
            fresh = [k for k, ids in asked.items() if ids is None]
            asked.update(zip(fresh, encode(fresh), strict=True))
            found = [asked[k] if ids is None else ids for k, ids in zip(keys, found, strict=True)]
            memory.put_all({k: ids for k, ids in asked.items() if len(k) <= CACHE_CHARS})
        return found

    def encode_array(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end`` behind each of them, one text after another, and where each of them ends."""
        if not self.by_parts:
            found = [ids + end for ids in self._by_library(texts.to_pylist())]
            return np.frombuffer(b"".join(found), "<u4"), np.cumsum([len(f) // 4 for f in found], dtype=np.int64)
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        parts = coded.dictionary
        word, tail = pc.extract_regex(parts, _WORD_AND_TAIL).flatten()
        is_word = pc.fill_null(pc.less_equal(pc.utf8_length(word), CACHE_CHARS), False)
        words, tails = pc.utf8_lower(word.filter(is_word)).dictionary_encode(), tail.filter(is_word).dictionary_encode()
        whole = parts.filter(pc.invert(is_word)).to_pylist()
        by_word = self._known(self.words, words.dictionary.to_pylist(), self._by_model)
        by_tail = self._known(self.parts, tails.dictionary.to_pylist(), self._by_library)
        pieces = [b"", end, *by_word, *by_tail, *self._known(self.parts, whole, self._by_library)]
        # Of each distinct part, and then of the end, two pieces.
        at = np.zeros((len(parts) + 1, 2), np.int64)
        at[-1, 0] = 1
        mask = np.append(is_word.to_numpy(zero_copy_only=False), False)
        at[mask, 0] = 2 + words.indices.to_numpy()
        at[mask, 1] = 2 + len(by_word) + tails.indices.to_numpy()
        at[:-1][~mask[:-1], 0] = 2 + len(by_word) + len(by_tail) + np.arange(len(whole))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat, ends = _gather(np.frombuffer(b"".join(pieces), "<u4"), sizes, at.ravel())
        sizes = np.diff(ends[1::2], prepend=0)
        stops = split.offsets.to_numpy()[1:]
        picked = np.insert(coded.indices.to_numpy().astype(np.int64), stops, len(parts))
        ids, ends = _gather(flat, sizes, picked)
        return ids, ends[stops + np.arange(len(stops))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, ends = self.encode_array(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if texts else []


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``CHUNK_BYTES`` of text, or of one row."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    first = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > CHUNK_BYTES:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if len(sizes):
        yield batch.slice(first)


_ENCODERS: dict[str, Encoder] = {}


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Write (doc_id, part, place, in_part, n_tokens, ids) to ``path`` in ascending order of the id.

    ``ids`` are those of the whole text and ``end_id``. Files follow each other in the order of ``part``, rows
    in that of ``place``; ``in_part`` counts the ids of the part before the row. Rows of one id follow by text; null ids come first; a null text
    is empty. Texts are dealt once, by ranges of the id, and encoded where they are written.
    """
    named = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    ordered = named.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer)
        try:
            yield from encoded(batches, part, _ENCODERS[tokenizer])
        finally:
            # Spark uses a worker again for other work, so it is left with little.
            _ENCODERS[tokenizer].forget(KEPT_ENTRIES)

    def encoded(batches: Iterator[pa.RecordBatch], part: int, encoder: Encoder) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        place = before = 0
        for batch in (c for b in batches for c in _chunks(b, 1)):
            ids, ends = encoder.encode_array(batch.column(1), end)
            sizes = np.diff(ends, prepend=0)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.view("<i4")))
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)),
                    pa.array(before + ends - sizes), pa.array(sizes), lists,
                ],
                ["doc_id", "part", "place", "in_part", "n_tokens", "ids"],
            )
            place += n
            before += int(ends[-1])

    rows = map_batches(ordered, work, "doc_id long, part int, place long, in_part long, n_tokens long, ids array<int>")
    rows.write.options(**WRITER).parquet(path)


def _bases(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids before each part. A part has one total, so this is as small as the number of files."""
    totals = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))


def read_token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, place, start, n_tokens) from the metadata columns alone; the ids are not read."""
    rows = spark.read.parquet(path).join(F.broadcast(_bases(spark, path)), "part")
    return rows.select("doc_id", "part", "place", (F.col("base") + F.col("in_part")).alias("start"), "n_tokens")


def read_token_checks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the written files: the checksum is over the ids as little-endian 32-bit numbers."""
    rows = spark.read.parquet(path).select("doc_id", "part", "in_part", "n_tokens", "ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            offsets = lists.offsets.to_numpy()
            flat = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).tobytes())
            checks = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            counted = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), counted, pa.array(checks, pa.int64())],
                ["doc_id", "part", "in_part", "n_tokens", "ids_crc32"],
            )

    checked = map_batches(rows, work, "doc_id long, part int, in_part long, n_tokens long, ids_crc32 long")
    return checked.join(F.broadcast(_bases(spark, path)), "part").select(
        "doc_id", (F.col("base") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_output(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Write the token files (to ``path``, by default a fresh folder of the shared one) and read the checks back; see ``write_token_ids``."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_token_ids(docs, path, tokenizer, key, text)
    return read_token_checks(spark, path)
