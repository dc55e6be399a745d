"""Records that run over lines, read in many tasks: from one large delimited or JSON file as well as from many small ones.

Spark's text source cuts a file into blocks. A first pass finds, block by block, in which state a block ends for each state that it may begin in;
these short rows are chained per file, and a second pass reads the records of each block from its known state. A record that crosses
blocks comes in fragments, which are put together at the end. Nothing passes the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexlake.session import written

# Characters of a line up to which it is looked at as a document of its own.
LINE_CHARS = 64 << 20

# Rows and, a single row aside, bytes that a task gets at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 2 << 20

WHOLE, HEAD, TAIL, MARK = "whole", "head", "tail", "mark"
_PART = "file string, block long, kind string, first boolean, top string, text string"
_NAMES = ["file", "block", "kind", "first", "top", "text"]
Row = tuple[str, bool, str | None, str | None]


def blocks_of(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """(``file``, ``block``, ``size``, ``value``): pieces between separators; those of one block follow each other."""
    read = spark.read.option("lineSep", separator).option("recursiveFileLookup", "true").text(path)
    meta = F.col("_metadata")
    return read.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[tuple], list[str]]]:
    """(file, block, further columns of its first row, values) of the rows of a batch that belong together."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        begin = 0
        for k in range(1, batch.num_rows + 1):
            if k == batch.num_rows or columns[0][k] != columns[0][begin] or columns[1][k] != columns[1][begin]:
                yield columns[0][begin], columns[1][begin], [c[begin] for c in columns[2:-1]], columns[-1][begin:k]
                begin = k


def _state(known: DataFrame) -> DataFrame:
    """``known`` (``file``, ``block``, ``out_in``, ``in_in``: inside after a block begun outside or inside) with ``inside`` at its begin.

    A block keeps the state, turns it over, or sets it; the state is the one last set, turned over as often as it was since.
    """
    by_file = Window.partitionBy("file").orderBy("block")
    upto = by_file.rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("out_in") == F.col("in_in")
    turns = F.sum(F.when(F.col("out_in") & ~F.col("in_in"), 1).otherwise(0)).over(by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.last(F.when(same, F.struct("out_in", "turns")), ignorenulls=True).over(upto)
    before = F.coalesce(F.lag("turns").over(by_file), F.lit(0))
    since = before - F.coalesce(F.col("last.turns"), F.lit(0))
    return (
        known.withColumn("turns", turns).withColumn("last", last).withColumn("since", since)
        .withColumn("inside", F.coalesce(F.col("last.out_in"), F.lit(False)) != (F.col("since") % 2 == 1))
    )


def _joined(parts: DataFrame, glue: str, keep: Callable[[DataFrame], DataFrame] = lambda sewn: sewn) -> DataFrame:
    """(``file``, ``top``, ``first``, ``text``) of whole records and of those put together from their fragments, as far as ``keep`` lets them."""
    whole = parts.where(F.col("kind") == WHOLE).select("file", "top", "first", "text")
    ends = parts.where(F.col("kind").isin(HEAD, TAIL))
    # "head" sorts before "tail": what a block begins with ends an earlier record.
    record = F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block", "kind"))
    sewn = ends.withColumn("record", record).groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("block", "kind", "text"))).alias("p"), F.bool_or("first").alias("first"),
        F.first(F.when(F.col("kind") == TAIL, F.col("top")), ignorenulls=True).alias("top"),
    )
    return whole.union(keep(sewn.select("file", "top", "first", F.array_join(F.col("p.text"), glue).alias("text"))))


def _map(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes: a piece is as long as a text, so rows alone bound nothing."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


# ---- delimited text ----


def ends_inside(line: str, inside: bool, sep: str, quote: str = '"') -> bool:
    """Whether a quoted cell is open behind ``line``, if it is (not) open in front of it. A quote opens a cell only as its first character."""
    if quote not in line:
        return inside
    at = 0
    while True:
        if not inside and line.startswith(quote, at):
            inside, at = True, at + 1
        if inside:
            while True:
                at = line.find(quote, at)
                if at < 0:
                    return True
                if not line.startswith(quote, at + 1):
                    break
                at += 2
            inside = False
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def delimited_records(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """(``file``, ``first``, ``text``): the records of delimited files, a quoted line break included; ``first`` is that of its file.

    Lines end with a line feed, with or without a carriage return. Blank records are left out.
    """
    lines = blocks_of(spark, path, "\n").select("file", "block", "value")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends = None, [False, True]
        for file, block, _, values in _runs(batches):
            if now != (file, block):
                if now is not None:
                    yield pa.RecordBatch.from_pydict({"file": [now[0]], "block": [now[1]], "out_in": [ends[0]], "in_in": [ends[1]]})
                now, ends = (file, block), [False, True]
            for line in values:
                if '"' in line:
                    ends = [ends_inside(line, e, sep) for e in ends]
        if now is not None:
            yield pa.RecordBatch.from_pydict({"file": [now[0]], "block": [now[1]], "out_in": [ends[0]], "in_in": [ends[1]]})

    known = _state(_map(lines, scan, "file string, block long, out_in boolean, in_in boolean"))
    # Only blocks that begin inside a cell are named, a short row each; joined where the lines are, these keep their order.
    opened = written(known.where("inside").select("file", "block", "inside"), "opened")
    placed = lines.join(F.broadcast(opened), ["file", "block"], "left").select("file", "block", "inside", "value")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, inside, fresh = None, [], False, False

        def rows(values: list[str]) -> Iterator[Row]:
            nonlocal held, inside, fresh
            for line in values:
                held.append(line)
                inside = ends_inside(line, inside, sep)
                if not inside:
                    yield (WHOLE if fresh else HEAD, first(), None, "\n".join(held))
                    held, fresh = [], True

        def first() -> bool:
            nonlocal begun
            was, begun = begun, True
            return not was

        def rest() -> list[Row]:
            return [(TAIL if fresh else HEAD, first(), None, "\n".join(held))] if held else []

        begun = True
        for file, block, (opened_,), values in _runs(batches):
            out: list[Row] = []
            if now != (file, block):
                if now is not None and held:
                    yield _batch(*now, rest())
                now, held, inside, fresh, begun = (file, block), [], bool(opened_), not opened_, block > 0
            out.extend(rows(values))
            if out:
                yield _batch(file, block, out)
        if now is not None and held:
            yield _batch(*now, rest())

    records = _joined(_map(placed, cut, _PART), "\n")
    return records.select("file", "first", F.regexp_replace("text", r"\r\z", "").alias("text")).where(F.trim("text") != "")


def _batch(file: str, block: int, rows: list[Row]) -> pa.RecordBatch:
    n = len(rows)
    columns = [pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.string(), pa.string()))]]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


# ---- JSON ----

_STRING = r'"(?:[^"\\]++|\\.)*+"'
_STRINGS = re.compile(_STRING, re.S)
_IN_STRING = re.compile(r'(?:[^"\\]++|\\.)*+', re.S)
_TOKENS = re.compile(rf'({_STRING})(\s*:)?|"|[\[\]{{}}]', re.S)


def _change(text: str, inside: bool) -> tuple[bool, int]:
    """(inside a string behind ``text``, change of depth), if it begins (not) inside a string."""
    if inside:
        at = _IN_STRING.match(text).end()
        if at >= len(text) or text[at] != '"':
            return True, 0
        text = text[at + 1 :]
    bare, lone, _ = _STRINGS.sub("", text).partition('"')
    return bool(lone), bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")


def _even(line: str) -> bool:
    """Whether all strings and brackets of a line are closed. A parser would take what it has read of others for rows."""
    return _change(line, False) == (False, 0)


def _is_document(line: str) -> bool:
    line = line.strip()
    if not (line.startswith("{") and line.endswith("}") and '"data"' in line):
        return False
    try:
        found = json.loads(line)
    except ValueError:
        return False
    return isinstance(found, dict) and isinstance(found.get("data"), list)


class _Elements:
    """Elements of the arrays under the top-level keys of JSON documents, from a known place in a string or a depth on."""

    def __init__(self, inside: bool, depth: int) -> None:
        self.inside, self.depth = inside, depth
        self.held: list[str] = []
        self.open = depth > 2
        self.kind = HEAD if self.open else TAIL
        self.key = None
        self.top: str | None = None

    def feed(self, text: str) -> Iterator[Row]:
        at = begin = 0
        if self.inside:
            at = _IN_STRING.match(text).end()
            self.inside = at >= len(text)
            at += 1
        for token in _TOKENS.finditer(text, at) if not self.inside else ():
            mark = token[0][0]
            if token[1] is not None:
                if self.depth == 1 and token[2] is not None:
                    self.key = token[1][1:-1]
            elif mark == '"':
                self.inside = True
                break
            elif mark in "{[":
                if self.depth == 1:
                    self.top = f"{self.key}{mark}"
                elif self.depth == 2 and mark == "{":
                    self.open, begin = True, token.start()
                self.depth += 1
            else:
                self.depth = max(self.depth - 1, 0)
                if self.depth == 2 and self.open:
                    self.held.append(text[begin : token.end()])
                    # "first" says here that a fragment is the last one of its record.
                    yield (HEAD if self.kind == HEAD else WHOLE, True, self.top, "".join(self.held))
                    self.open, self.kind, self.held = False, TAIL, []
        if self.open:
            self.held.append(text[begin:])

    def rest(self) -> Iterator[Row]:
        if self.open and self.held:
            yield (self.kind, False, self.top, "".join(self.held))
        yield (MARK, False, self.top, None)


class _Lines:
    """Lines; what stands before the first line feed of a block ends a line of an earlier one."""

    def __init__(self, begins: bool) -> None:
        self.kind = WHOLE if begins else HEAD
        self.held: list[str] = []

    def feed(self, text: str) -> Iterator[Row]:
        *whole, last = text.split("\n")
        for line in whole:
            line = "".join([*self.held, line])
            if self.kind == HEAD or _even(line):
                yield (self.kind, True, "line", line)
            self.held, self.kind = [], WHOLE
        self.held.append(last)

    def rest(self) -> Iterator[Row]:
        yield (TAIL if self.kind == WHOLE else HEAD, True, "line", "".join(self.held))


def envelope_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(``by_line``, ``text``): what JSON documents ``{..., "data": [{...}, ...]}`` hold, in tasks by blocks of each file.

    A file in which some line within a block is such a document by itself holds one document per line: each line is a row, and a faulty one costs
    only itself. Any other file is read as documents over as many lines as they like, and the objects of their ``data`` are rows; there a fault
    ends at the next place where brackets are even again.
    """
    pieces = blocks_of(spark, path, "}")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, inn, line, held, by_line, count, size = None, (False, 0), (True, 0), [], 0, False, 0, 0

        def row() -> pa.RecordBatch:
            values = {"file": now[0], "block": now[1], "size": size, "out_in": out[0], "out_d": out[1], "in_in": inn[0], "in_d": inn[1], "by_line": by_line, "bytes": count}
            return pa.RecordBatch.from_pydict({k: [v] for k, v in values.items()})

        for file, block, (length,), values in _runs(batches):
            if now != (file, block):
                if now is not None:
                    by_line = by_line or _is_document("".join(line))
                    yield row()
                now, out, inn, line, held, by_line, count, size = (file, block), (False, 0), (True, 0), [], 0, False, 0, length
            text = "}".join(values) + "}"
            count += len(text.encode("utf-8", "surrogatepass"))
            for k, start in enumerate((out, inn)):
                inside, more = _change(text, start[0])
                if k == 0:
                    out = (inside, start[1] + more)
                else:
                    inn = (inside, start[1] + more)
            if not by_line:
                *whole, last = text.split("\n")
                if whole:
                    by_line = _is_document("".join([*line, whole[0]])) or any(_is_document(x) for x in whole[1:])
                    line, held = [], 0
                if not by_line:
                    line.append(last)
                    held += len(last)
                    if held > LINE_CHARS:
                        line, held = [], 0
        if now is not None:
            by_line = by_line or _is_document("".join(line))
            yield row()

    schema = "file string, block long, size long, out_in boolean, out_d long, in_in boolean, in_d long, by_line boolean, bytes long"
    known = _state(written(_map(pieces, scan, schema), "blocks"))
    by_file = Window.partitionBy("file")
    moved = F.when(F.col("inside"), F.col("in_d")).otherwise(F.col("out_d"))
    depth = F.coalesce(F.sum(moved).over(by_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    # Every piece counts a bracket more than its text; the last one of a file has none if that is one byte (or a byte order mark less) more than the file.
    over = F.sum("bytes").over(by_file) - F.col("size")
    last = F.col("block") == F.max("block").over(by_file)
    states = known.select("file", "block", "inside", depth.alias("depth"), F.max("by_line").over(by_file).alias("by_line"), (last & over.isin(1, -2)).alias("bare"))
    # A row per block, joined where the pieces are, so that these keep their order.
    states = written(states, "states")
    placed = pieces.join(F.broadcast(states), ["file", "block"]).select("file", "block", "inside", "depth", "by_line", "bare", "value")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, ahead, bare = None, None, "", False
        for file, block, (inside, depth, by_line, open_end), values in _runs(batches):
            if now != (file, block):
                if now is not None:
                    yield _batch(*now, [*reader.feed(ahead[:-1] if bare else ahead), *reader.rest()])
                now, reader, ahead, bare = (file, block), _Lines(block == 0) if by_line else _Elements(inside, depth), "", open_end
            # One piece is held back, since the bracket behind the last one may not be there.
            out = list(reader.feed(ahead + "".join([v + "}" for v in values[:-1]]))) if ahead or len(values) > 1 else []
            ahead = values[-1] + "}"
            if out:
                yield _batch(file, block, out)
        if now is not None:
            yield _batch(*now, [*reader.feed(ahead[:-1] if bare else ahead), *reader.rest()])

    parts = written(_map(placed, cut, _PART), "parts")
    # Under which key a block begins is known from the blocks before it.
    marks = parts.where(F.col("kind") == MARK).select("file", "block", "top")
    seen = F.last("top", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    tops = marks.select("file", "block", seen.alias("seen"))
    named = parts.where(F.col("kind") != MARK).join(F.broadcast(tops), ["file", "block"], "left")
    named = named.select("file", "block", "kind", "first", F.coalesce("top", "seen").alias("top"), "text")

    def even(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([top != "line" or _even(x) for top, x in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_()))

    # A record that never ends, as in a file that breaks off, is left out.
    closed = lambda sewn: _map(sewn.where("first"), even, "file string, top string, first boolean, text string")
    found = _joined(named, "", closed).where(F.col("top").isin("line", "data["))
    return found.select((F.col("top") == "line").alias("by_line"), "text")
