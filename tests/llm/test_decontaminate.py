import random
import re

import pytest
from helpers import clashing, no_docs, odd_docs

from lexlake.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench, window=10):
    wins = {}
    for item, text in bench:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    out = []
    for key, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    items |= wins[tuple(w[k : k + n])]
        out.append((key, len(w), len(hit), tuple(sorted(items))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,shard", [(200_000, 2_000_000), (3, 40)])
def test_against_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(d, "BLOCK_WINDOWS", block)
    rng = random.Random(1)
    bench = [(i, " ".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 14])))) for i in range(12)] + [(99, None), (100, "A-b.C a B c")]
    docs = [(i, "\n".join(rng.choice(["a", "B", "c", "zz", "é,x"]) for _ in range(rng.randrange(120)))) for i in range(60)]
    docs += [(1000 + i, "x " + (t or "") + ", y") for i, (_, t) in enumerate(bench)] * 2 + [(None, None), (5, "")]
    found = d.decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), shard_words=shard
    ).collect()
    assert sorted([(r["doc_id"], r["bm_words"], r["bm_hit"], tuple(r["bm_items"])) for r in found], key=str) == brute(docs, bench)
    for r in found:
        assert sum(s["words"] for s in r["bm_spans"]) == r["bm_hit"]
        if r["bm_hit"]:
            assert len(words(r["bm_text"])) == r["bm_words"] - r["bm_hit"]
        else:
            assert r["bm_text"] == r["text"]


def test_odd_rows_names_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "four FIVE six seven eight nine ten eleven twelve")], "item_id long, text string")
    docs = clashing(odd_docs(spark))
    found = d.decontaminate(docs, bench)
    rows = {(r["doc_id"], r["bm_words_"], r["bm_hit"]) for r in found.collect()}
    assert (5, 12, 9) in rows and (3, 0, 0) in rows and found.count() == docs.count()
    assert {r["bm_words"] for r in found.collect()} == {"taken"}
    assert d.decontaminate(no_docs(spark), bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminate(docs, none).where("bm_hit > 0").count() == 0
