"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Rows in one Arrow batch: a batch of texts stays at some megabytes even where documents are long.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20

# A side is broadcast only below this many rows of a few bytes each; beyond it, the join is shuffled.
SMALL_ROWS = 1_000_000

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
# Words of letters, digits and all non-ASCII characters: everything else becomes a blank.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_LOWER_AZ = bytes.maketrans(_UPPER, _LOWER)


def plain_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes after lower-casing A-Z."""
    return text.translate(_PLAIN).split()


def blank_words(text: bytes, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes (``bytes.split`` parts at just these six)."""
    return (text.translate(_LOWER_AZ) if lower else text).split()


def plain_table() -> bytes:
    return _PLAIN


class Memory:
    """Bounded memory of two generations: what was asked for lately stays when the older half is dropped."""

    def __init__(self, entries: int) -> None:
        self.entries = entries
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def put(self, key, value) -> None:
        if len(self.young) >= self.entries:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def put_all(self, entries: dict) -> None:
        """Put many entries at once; more of them than a generation holds stay until the next call."""
        if len(self.young) + len(entries) > self.entries:
            self.old, self.young = self.young, {}
        self.young.update(entries)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_bytes(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("binary"), F.lit(b""))


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows and, a single row aside, ``BATCH_BYTES`` bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


def with_code(df: DataFrame, text: str, name: str, code: Callable[[bytes], int]) -> DataFrame:
    """``df`` with a long column ``name``: ``code`` of each text as signed 64 bits, null texts as empty ones."""
    place = df.columns.index(text)
    names = [*df.columns, name]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() if isinstance(t, str) else t or b"" for t in batch.column(place).to_pylist()]
            found = np.array([code(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_batches(df, work, f"{fields}, `{name}` long")


def heads_only(docs: DataFrame, heads: DataFrame, key: str, text: str, code: Callable[[bytes], int]) -> DataFrame:
    """Rows of ``docs`` that ``heads`` (``doc_id``, ``code``, ``times``: rows of that id and code) names, one for each: of several,
    the one with the least text. Rows without an id stay. The columns are those of ``docs``."""
    name, own, head, times = (free_name(docs, wanted) for wanted in ("code_", "head_code_", "head_", "times_"))
    n = heads.count()
    side = small_or_plain(heads.select(F.col("doc_id").alias(head), F.col("code").alias(own), F.col("times").alias(times)), n)
    coded = with_code(docs.where(F.col(f"`{key}`").isNotNull()), text, name, code)
    kept = coded.join(side, (F.col(f"`{key}`") == F.col(head)) & (F.col(name) == F.col(own)))
    once = kept.where(F.col(times) == 1).select([F.col(f"`{c}`") for c in docs.columns])
    if not heads.where("times > 1").isEmpty():
        rank = F.row_number().over(Window.partitionBy(head, own).orderBy(f"`{text}`"))
        several = kept.where(F.col(times) > 1).withColumn(times, rank).where(F.col(times) == 1)
        once = once.unionByName(several.select([F.col(f"`{c}`") for c in docs.columns]))
    return once.unionByName(docs.where(F.col(f"`{key}`").isNull()))


def small_or_plain(side: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a written side whose counted rows are few; no hint otherwise."""
    return F.broadcast(side) if rows <= SMALL_ROWS else side


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
