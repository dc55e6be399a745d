"""Repair of conversation structure at least cost: block tables of normalised cost vectors, traced from block to block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import map_batches
from lexlake.session import written

RELABEL, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1
# Symbols of a block.
BLOCK = 3
# Rows and bytes of a conversation that a task holds at a time.
SEGMENT_ROWS = 4096
SEGMENT_BYTES = 8 << 20

# Symbols: what a row's role begins with, then the same with an unfinished text; the last one must be deleted.
ROLES = "sua?"
GONE = 2 * len(ROLES)
SYMBOLS = GONE + 1
# States of the roles so far, (s?(ua)+)?: nothing, after s, after u, after a. The role that an edit may give in each, and the state after it.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (("user", AFTER_U), ("user", AFTER_U), ("assistant", AFTER_A), ("user", AFTER_U))
_FAR = 1 << 30


def after_keeping(state: int, symbol: int) -> int | None:
    """State after a row that stays as it is, or None if it cannot stay."""
    role = ROLES[symbol % len(ROLES)] if symbol != GONE else "?"
    if role == "s":
        return AFTER_S if state == START else None
    return NEXT[state][1] if role == NEXT[state][0][0] else None


def _with_inserts(cost: list[int]) -> tuple[int, ...]:
    for _ in NEXT:
        cost = [min(c, INSERT + cost[to]) for c, (_, to) in zip(cost, NEXT, strict=True)]
    return tuple(cost)


END = _with_inserts([0, _FAR, _FAR, 0])


def before(symbol: int, cost: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs to the end from before a row, by state, if ``cost`` are those from behind it."""
    out = []
    for state, (_, to) in enumerate(NEXT):
        best = DELETE + cost[state]
        if symbol != GONE:
            extra = UNFINISHED * (symbol // len(ROLES))
            best = min(best, RELABEL + extra + cost[to])
            kept = after_keeping(state, symbol)
            if kept is not None:
                best = min(best, extra + cost[kept])
        out.append(best)
    return _with_inserts(out)


class BlockTables:
    """Transitions of normalised cost vectors over every block of ``block`` symbols.

    Inserting keeps the costs of two states within a bound of each other, so that only a few vectors less their least
    entry exist. ``to[vector, block]`` is the vector before the block and ``add`` what its least entry grows by; a block is
    read as a number whose last digit is its last symbol.
    """

    def __init__(self, block: int = BLOCK) -> None:
        self.block = block
        normal = lambda v: (tuple(c - min(v) for c in v), min(v))
        self.vectors = [normal(END)[0]]
        number = {self.vectors[0]: 0}
        one: list[list[tuple[int, int]]] = []
        while len(one) < len(self.vectors):
            row = []
            for symbol in range(SYMBOLS):
                vector, least = normal(before(symbol, self.vectors[len(one)]))
                if vector not in number:
                    number[vector] = len(self.vectors)
                    self.vectors.append(vector)
                row.append((number[vector], least))
            one.append(row)
        self.one = one
        n = len(self.vectors)
        to, add = np.zeros((n, SYMBOLS**block), np.int32), np.zeros((n, SYMBOLS**block), np.int32)
        for at, symbols in enumerate(product(range(SYMBOLS), repeat=block)):
            for v in range(n):
                here, more = v, 0
                for symbol in reversed(symbols):
                    here, grown = one[here][symbol]
                    more += grown
                to[v, at], add[v, at] = here, more
        # Plain lists are read faster one by one.
        self.to, self.add = to.tolist(), add.tolist()

    def back(self, symbols: bytes, vector: int = 0) -> tuple[int, int, list[int], int]:
        """(vector before, growth, vectors behind each whole block, symbols after the last of these), from ``vector`` behind ``symbols``."""
        grown, rest = 0, len(symbols) % self.block
        blocks = np.frombuffer(symbols, np.uint8)[: len(symbols) - rest].reshape(-1, self.block).astype(np.int64)
        codes = blocks @ (SYMBOLS ** np.arange(self.block - 1, -1, -1))
        for symbol in reversed(symbols[len(symbols) - rest :]):
            vector, more = self.one[vector][symbol]
            grown += more
        behind = []
        for code in codes[::-1].tolist():
            behind.append(vector)
            grown += self.add[vector][code]
            vector = self.to[vector][code]
        return vector, grown, behind[::-1], rest

    def trace(self, symbols: bytes, state: int, vector: int = 0, last: bool = True) -> tuple[str, list[str | None], int]:
        """(edits, roles, state): the edits of least cost from ``state`` on whose initials come first in ASCII, the role each edit gives.

        ``vector`` holds the costs behind ``symbols``. Each block is expanded backward from the vector behind it into the vectors between its
        symbols, and followed forward. With ``last``, rows still missing at the end are inserted.
        """
        _, _, behind, rest = self.back(symbols, vector)
        edits: list[str] = []
        roles: list[str | None] = []
        cuts = [(k * self.block, (k + 1) * self.block, v) for k, v in enumerate(behind)]
        if rest:
            cuts.append((len(symbols) - rest, len(symbols), vector))
        for begin, end, after in cuts:
            costs = [self.vectors[after]]
            for symbol in reversed(symbols[begin:end]):
                costs.append(before(symbol, costs[-1]))
            costs.reverse()
            for symbol, here, then in zip(symbols[begin:end], costs, costs[1:], strict=False):
                while True:
                    role, to = NEXT[state]
                    if here[state] == DELETE + then[state]:
                        edits.append("D")
                        roles.append(None)
                        break
                    if here[state] == INSERT + here[to]:
                        edits.append("I")
                        roles.append(role)
                        state = to
                        continue
                    extra = UNFINISHED * (symbol // len(ROLES))
                    kept = after_keeping(state, symbol)
                    if kept is not None and here[state] == extra + then[kept]:
                        edits.append("K")
                        roles.append(None)
                        state = kept
                    else:
                        edits.append("R")
                        roles.append(role)
                        state = to
                    break
        while last and END[state]:
            role, state = NEXT[state]
            edits.append("I")
            roles.append(role)
        return "".join(edits), roles, state


@lru_cache(maxsize=1)
def tables() -> BlockTables:
    return BlockTables()


def damage(rows: DataFrame) -> DataFrame:
    """Rows (``conv_id``, ``turn``, ``role``, ``text``, ``copies``) of conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties the text, 2 takes ``[.!?]`` out of it, 3 doubles the row, 4 makes it a user's. Nulls are one
    space, but a null turn stays null.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    named = rows.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), case.alias("case"))
    return named.where("case <> 0").select(
        "conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("case") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _turn(side: str) -> Column:
    """Turns in their order: a null one is the first."""
    return F.struct(F.col(f"{side}.turn").isNotNull().alias("known"), F.col(f"{side}.turn").alias("turn"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``copies``, ``fault`` (``b`` blank, ``d`` seen in an earlier turn, ``t`` truncated) and ``symbol``, by conversation and turn.

    Equal rows are added up, and looked up by a hash of 256 bits, before they are dealt by ranges of conversation, turn, role and text, so
    neither a long conversation nor a row that is repeated very often lies in one task.
    """
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("key", key)
    one = written(one, "turns")
    firsts = one.alias("x").groupBy("conv_id", "key").agg(F.min(_turn("x")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = one.alias("o").join(firsts.alias("f"), F.col("o.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("o.key") == F.col("f.key")), "left")
    seen = F.coalesce(_turn("o") != F.col("f.first"), F.lit(False))
    cut = F.rtrim(F.col("o.text"), F.lit(" \t\n\x0b\x0c\r"))
    initial = F.substring("o.role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    ended = F.substring(cut, -1, 1).isin(".", "!", "?")
    fault = F.when(cut == "", "b").when(seen, "d").when(ended, "").otherwise("t")
    symbol = F.when((cut == "") | seen, GONE).when(ended, role).otherwise(role + len(ROLES))
    return (
        same.select("o.conv_id", "o.turn", "o.role", "o.text", "o.copies", fault.alias("fault"), symbol.cast("int").alias("symbol"), role.cast("int").alias("initial"))
        .repartitionByRange("conv_id", "turn", "role", "text")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )


class _Part:
    """Rows of one conversation that follow each other."""

    def __init__(self) -> None:
        self.symbols, self.initials = bytearray(), bytearray()
        self.roles: list[str | None] = []
        self.texts: list[str | None] = []
        self.faults = {"b": 0, "d": 0, "t": 0, "": 0}
        self.low = self.high = None
        self.turns = self.size = 0

    def add(self, symbol: int, initial: int, role: str | None, text: str | None, turn: int | None, fault: str, times: int = 1) -> None:
        self.symbols += bytes([symbol]) * times
        self.initials += bytes([initial]) * times
        # What must be deleted is not needed again.
        self.roles += [None if symbol == GONE else role] * times
        self.texts += [None if symbol == GONE else text] * times
        self.faults[fault] += times
        self.size += 0 if symbol == GONE else len(text) + len(role)
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn


def _parts(ordered: DataFrame, rows: int, size: int) -> DataFrame:
    """Conversations in parts of at most ``rows`` rows and about ``size`` characters; ``whole`` where a part is all of its conversation.

    The first and the last conversation of a range may go on in its neighbours; ``seq`` gives the order of all parts.
    """
    kind = ordered.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, seq long, whole boolean, symbols binary, initials binary, roles array<string>, texts array<string>, "
        "blank long, duplicate long, truncated long, low long, high long, turns long"
    )
    names = [f.split()[0] for f in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 32
        arrow = None

        def batch_of(conv_id: object, part: _Part, whole: bool) -> pa.RecordBatch:
            nonlocal seq
            seq += 1
            texts = pa.list_(pa.string())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([conv_id], arrow), pa.array([seq]), pa.array([whole]), pa.array([bytes(part.symbols)]), pa.array([bytes(part.initials)]),
                    pa.array([part.roles], texts), pa.array([part.texts], texts),
                    *[pa.array([part.faults[f]]) for f in "bdt"], *[pa.array([x], pa.int64()) for x in (part.low, part.high, part.turns)],
                ],
                names,
            )

        part, now, inner, cut = None, None, False, False
        for batch in batches:
            arrow = batch.schema.field(0).type
            for conv_id, turn, role, text, copies, fault, symbol, initial in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is None or conv_id != now:
                    if part is not None:
                        yield batch_of(now, part, inner and not cut)
                    inner, cut = part is not None, False
                    part, now = _Part(), conv_id
                again = fault if fault in ("b", "d") else "d"
                left = copies
                while left:
                    if len(part.symbols) >= rows or part.size >= size:
                        yield batch_of(now, part, False)
                        part, cut = _Part(), True
                    if left == copies:
                        part.add(symbol, initial, role, text, turn, fault)
                        left -= 1
                    else:
                        some = min(left, rows - len(part.symbols))
                        part.add(GONE, initial, None, None, turn, again, some)
                        left -= some
        if part is not None:
            yield batch_of(now, part, False)

    return written(map_batches(ordered, work, schema), "parts")


def _chain(parts: DataFrame) -> DataFrame:
    """(``seq``, ``vector``, ``last``, ``state``, ``before``, ``turn``) of parts that hang together.

    ``vector``: costs behind the part; ``last``: none follows; ``state``: that in which it begins; ``before`` and ``turn``: initial and turn in front
    of it. A conversation passes one task here, a part at a time and with one byte a row; texts do not.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vector, begun = None, 0, False
        for batch in batches:
            vectors, lasts = [], []
            for conv_id, symbols in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                new = not begun or conv_id != now
                if new:
                    now, vector, begun = conv_id, 0, True
                vectors.append(vector)
                lasts.append(new)
                vector = tables().back(symbols, vector)[0]
            columns = [*batch.columns, pa.array(vectors, pa.int32()), pa.array(lasts, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "seq", "symbols", "initials", "low", "high", "vector", "last"])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, state, initial, turn = None, False, START, -1, None
        for batch in batches:
            out = []
            for conv_id, seq, symbols, initials, _, high, vector, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv_id != now:
                    now, begun, state, initial, turn = conv_id, True, START, -1, None
                out.append((seq, vector, last, state, initial, turn))
                state = tables().trace(symbols, state, vector, False)[2]
                initial, turn = initials[-1], turn if high is None else high
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64())
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["seq", "vector", "last", "state", "before", "turn"])

    slim = parts.select("conv_id", "seq", "symbols", "initials", "low", "high")
    behind = slim.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seq"))
    schema = f"conv_id {kind}, seq long, symbols binary, initials binary, low long, high long, vector int, last boolean"
    known = written(map_batches(behind, backward, schema), "behind")
    ahead = known.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return written(map_batches(ahead, forward, "seq long, vector int, last boolean, state int, before int, turn long"), "chain")


_COSTS = {"K": 0, "D": DELETE, "I": INSERT, "R": RELABEL}
# Pairs of initials (su, ua, au) that may follow each other, as places in ROLES.
_LEGAL = np.array([0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])


def repair_turns(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Conversations (``conv_id``, ``turn``, ``role``, ``text``, ``copies``) with the cheapest edits that bring their roles into ``(s?(ua)+)?``.

    Rows: (``conv_id``, ``seq``, ``whole``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``low``, ``high``, ``turns``, ``cost``,
    ``edits``, ``repaired``), one per conversation (``whole``), or several for one that is longer than ``segment_rows`` rows or
    ``segment_bytes`` characters or lies at the border of a range of the sort; these are in the order of ``seq`` and their numbers add up. ``edits`` are the
    initials of Keep, Rerole, Delete and Insert, ``repaired`` the turns (role, text) that they leave, ``turns`` counts the distinct turns from
    ``low`` to ``high``.

    Rows go by turn (nulls first), then role and text. A row is blank, or else a duplicate (role and text occur in an earlier row), or else truncated
    (the last character that is no blank is none of ``.!?``). Blank and duplicate rows must go, a truncated one that stays costs ``UNFINISHED`` more. Of equally cheap
    edits those whose initials come first in ASCII are taken. Roles and texts must not be null; a null id is a conversation too; an empty
    table gives no rows; further columns are not read.
    """
    parts = _parts(_ordered(rows.select("conv_id", "turn", "role", "text", "copies")), segment_rows, segment_bytes)
    kind = parts.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, seq long, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, "
        "cost long, edits string, repaired array<struct<role:string,text:string>>"
    )
    names = [f.split()[0] for f in schema.split(", ")]
    turn_list = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                r = one.to_pylist()[0]
                edits, roles, _ = tables().trace(r["symbols"], r["state"], r["vector"], r["last"])
                at = cost = 0
                repaired = []
                for edit, role in zip(edits, roles, strict=True):
                    cost += _COSTS[edit]
                    if edit == "I":
                        repaired.append({"role": role, "text": ""})
                        continue
                    if edit != "D":
                        cost += UNFINISHED * (r["symbols"][at] // len(ROLES))
                        repaired.append({"role": r["roles"][at] if edit == "K" else role, "text": r["texts"][at]})
                    at += 1
                initials = np.frombuffer(r["initials"], np.uint8).astype(np.int64)
                if r["before"] >= 0:
                    initials = np.concatenate(([r["before"]], initials))
                illegal = int((~np.isin(initials[:-1] * 4 + initials[1:], _LEGAL)).sum())
                again = r["low"] is not None and r["low"] == r["turn"]
                numbers = [r["blank"], r["duplicate"], r["truncated"], illegal, r["low"], r["high"], r["turns"] - again, cost]
                yield pa.RecordBatch.from_arrays(
                    [*one.columns[:2], *[pa.array([x], pa.int64()) for x in numbers], pa.array([edits]), pa.array([repaired], turn_list)], names
                )

    columns = ["conv_id", "seq", "symbols", "initials", "roles", "texts", "blank", "duplicate", "truncated", "low", "high", "turns"]
    alone = [F.lit(0).alias("vector"), F.lit(True).alias("last"), F.lit(START).alias("state"), F.lit(-1).alias("before"), F.lit(None).cast("long").alias("turn")]
    split = parts.where("NOT whole")
    linked = split.join(_chain(split), "seq").select(*columns, "vector", "last", "state", "before", "turn")
    # A constant on each side, so that asking for one of them does not compute the other.
    done = map_batches(parts.where("whole").select(*columns, *alone), work, schema).withColumn("whole", F.lit(True))
    return done.union(map_batches(linked, work, schema).withColumn("whole", F.lit(False)))


def repair_report(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair_turns``: numbers, ``audit`` (all edits) and ``repaired_sha256`` over ``role:text`` lines.

    Parts of a conversation meet in one task, where they pass in order, one at a time; only the audit is held whole.
    """
    kind = repaired.schema["conv_id"].dataType.simpleString()
    numbers = ["blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"conv_id {kind}, gaps long, " + ", ".join(f"{n} long" for n in numbers) + ", audit string, repaired_sha256 string"
    names = [f.split()[0] for f in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[pa.DataType, dict]]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield batch.schema.field(0).type, batch.slice(k, 1).to_pylist()[0]

        for (conv_type, conv_id), parts in groupby(rows(), lambda t: (t[0], t[1]["conv_id"])):
            sums, audit, digest, begun = dict.fromkeys(numbers, 0), [], hashlib.sha256(), False
            low = high = None
            turns = 0
            for _, part in parts:
                for n in numbers:
                    sums[n] += part[n]
                audit.append(part["edits"])
                for turn in part["repaired"]:
                    digest.update(("\n" if begun else "").encode() + f"{turn['role']}:{turn['text']}".encode())
                    begun = True
                if part["low"] is not None:
                    low = part["low"] if low is None else low
                    high = part["high"]
                    turns += part["turns"]
            gaps = 0 if low is None else high - low + 1 - turns
            values = [gaps, *sums.values(), "".join(audit), digest.hexdigest()]
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], conv_type), *[pa.array([v]) for v in values]], names)

    columns = ["conv_id", "seq", "low", "high", "turns", *numbers, "edits", "repaired"]
    split = repaired.where("NOT whole").select(columns).repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return map_batches(repaired.where("whole").select(columns), work, schema).union(map_batches(split, work, schema))
