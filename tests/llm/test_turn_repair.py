import hashlib
import random
import re
import sys
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from lexlake.llm import turn_repair as t

SCHEMA = "conv_id long, turn long, role string, text string"
sys.setrecursionlimit(5000)  # the brute force goes down once a row
BLANKS = " \t\n\x0b\x0c\r"


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case == 0:
            continue
        row = (conv, turn, "user" if case == 4 else role, "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text)
        out += [row] * (2 if case == 3 else 1)
    return out


def least(rows):
    """(cost, audit) by trying every edit; rows are (initial, fault)."""

    @cache
    def go(i, state):
        # States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
        nxt = 3 if state == 2 else 2
        ways = [(0, "")] if i == len(rows) and state in (0, 3) else []
        if i == len(rows):
            if not ways:
                cost, audit = go(i, nxt)
                ways.append((cost + 2, "I" + audit))
            return min(ways)
        for inserted in (0, 1, 2):
            now, edits, paid = state, "", 0
            for _ in range(inserted):
                now = 3 if now == 2 else 2
                edits, paid = edits + "I", paid + 2
            cost, audit = go(i + 1, now)
            ways.append((paid + 3 + cost, edits + "D" + audit))
            initial, fault = rows[i]
            if fault in "bd" and fault:
                continue
            extra = fault == "t"
            to = 3 if now == 2 else 2
            cost, audit = go(i + 1, to)
            ways.append((paid + 2 + extra + cost, edits + "R" + audit))
            if initial == ("a" if now == 2 else "u"):
                ways.append((paid + extra + cost, edits + "K" + audit))
            if initial == "s" and now == 0:
                cost, audit = go(i + 1, 1)
                ways.append((paid + extra + cost, edits + "K" + audit))
        return min(ways)

    return go(0, 0)


def brute(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in hurt(rows) if r[0] == conv), key=order)
        faults, seen = [], set()
        for _, _, role, text in mine:
            cut = text.rstrip(BLANKS)
            faults.append("b" if not cut else "d" if (role, text) in seen else "t" if cut[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in mine]
        cost, audit = least(tuple(zip(initials, faults, strict=True)))
        said, i = [], 0
        for edit in audit:
            role = "assistant" if said and said[-1][:1] == "u" else "user"
            if edit == "I":
                said.append(f"{role}:")
            else:
                if edit != "D":
                    said.append(f"{mine[i][2] if edit == 'K' else role}:{mine[i][3]}")
                i += 1
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)
    return out


def conversations(seed, n, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            text = rng.choice(["Yes.", "No!", "so", "", " \n", "More? ", "é。", "Yes.", None, "w." * 30])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), role, text))
    return rows


def report(spark, rows, **limits):
    frame = spark.createDataFrame(rows, SCHEMA)
    done = t.repair_report(t.repair_turns(t.damage(frame), **limits))
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in done.collect()}


def expected(rows):
    left = {r[0] for r in hurt(rows)}
    return {conv: v for conv, v in brute(rows).items() if conv in left}


def test_random_conversations_against_brute_force(spark):
    rows = conversations(1, 300)
    assert report(spark, rows) == expected(rows)


@pytest.mark.parametrize("limits", [{"segment_rows": 1}, {"segment_rows": 4}, {"segment_bytes": 8}])
def test_conversations_in_parts_give_the_same(spark, limits):
    rows = conversations(2, 40, 30)
    assert report(spark, rows, **limits) == expected(rows)


def test_a_long_conversation_and_often_repeated_rows(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"text {k}" + "." * (k % 3)) for k in range(200)] + [(1, 7, "user", "Same.")] * 300 + conversations(3, 20)
    assert report(spark, rows, segment_rows=64) == expected(rows)


def test_block_tables_equal_single_steps():
    rng = random.Random(5)
    for block in (1, 2, 3):
        tables = t.BlockTables(block)
        for _ in range(200):
            symbols = bytes(rng.randrange(t.SYMBOLS) for _ in range(rng.randrange(12)))
            cost = t.END
            for s in reversed(symbols):
                cost = t.before(s, cost)
            vector, grown, _, _ = tables.back(symbols)
            assert tuple(c + grown for c in tables.vectors[vector]) == cost
    assert len(t.tables().vectors) < 100


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", ""), (2, 0, "user", "U"), (None, None, "tool", "T.")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit(1)).withColumn("key", F.lit("own"))
    got = {}
    for r in sorted(t.repair_turns(frame).collect(), key=lambda r: r["seq"]):  # a conversation may come in parts
        edits, turns = got.get(r["conv_id"], ("", []))
        got[r["conv_id"]] = (edits + r["edits"], turns + [tuple(x) for x in r["repaired"]])
    assert got == {1: ("KIKD", [("system", "S."), ("user", ""), ("assistant", "A.")]), 2: ("D", []), None: ("D", [])}


def test_odd_tables(spark):
    assert report(spark, []) == {}
    rows = [(1, None, None, None), (1, None, None, None), (1, None, "user", "x" * 100000), (None, 3, "user", "Hi.")]
    assert report(spark, rows) == expected(rows)
