import hashlib
import random

import pyarrow.parquet as pq
import pytest
from helpers import clashing, no_docs, odd_docs

from lexlake.llm import suffix


def brute(docs):
    """docs: (id, bytes). Every 100-byte string, in order of id and place."""
    seen, out = set(), []
    for i, text in sorted(docs):
        mark = bytearray(len(text))
        for p in range(len(text) - 99):
            w = text[p : p + 100]
            if w in seen:
                mark[p : p + 100] = b"\1" * 100
            else:
                seen.add(w)
        spans = sum(1 for p in range(len(text)) if mark[p] and (p == 0 or not mark[p - 1]))
        kept = bytes(c for c, m in zip(text, mark, strict=True) if not m)
        out.append((i, len(text), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(df):
    return sorted(
        (r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
        for r in suffix.remove_repeats(df).collect()
    )


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    passage = [" ".join(rng.choice(words) for _ in range(k)) for k in (15, 25, 30, 60)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.random()
            if kind < 0.4:
                parts.append(rng.choice(passage))
            elif kind < 0.5:
                p = rng.choice(passage)
                cut = rng.randrange(len(p))
                parts.append(p[:cut] + rng.choice("xyz") + p[cut:])
            elif kind < 0.6:
                parts.append(rng.choice(["ha ", "x", "ab cd "]) * rng.randrange(20, 90))
            else:
                parts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(40))))
        out.append((rng.randrange(10**9), "\n".join(parts)))
    return out


@pytest.mark.parametrize("hot,block", [(100, 2_000_000), (2, 300), (1, 2_000_000)])
def test_against_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(suffix, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(suffix, "SORT_WINDOWS", block)
    docs = corpus(hot, 150)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert run(df) == brute([(i, t.encode()) for i, t in docs])


def test_long_texts_in_parts(spark, monkeypatch):
    docs = [(1, "".join(random.Random(4).choice("abcd") for _ in range(3000))), (2, "0123456789" * 300)]
    docs += [(3, docs[0][1][700:2300] + "zz" + docs[1][1][5:900])]
    want = brute([(i, t.encode()) for i, t in docs])
    assert run(spark.createDataFrame(docs, "doc_id long, text string")) == want
    for part in (128, 1000):
        monkeypatch.setattr(suffix, "PART", part)
        first = [suffix.contexts(t.encode()) for _, t in docs]
        for (_, t), (_, _, place, count, _) in zip(docs, first, strict=True):
            assert count.sum() == len(t) - 99 and sorted(place.tolist())[0] == 0


def test_query_against_brute_force(spark):
    from lexlake.llm.queries import op9_suffix_dedup

    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows = op9_suffix_dedup(spark, "/root/testdata/sf0.01").collect()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)
    assert got == brute([(i, t.encode()) for i, t in zip(docs["doc_id"], docs["text"], strict=True)])


def test_merge_sort_orders_suffixes():
    import numpy as np

    rng = random.Random(9)
    data = bytes(rng.choice(b"ab") for _ in range(900))
    at = np.array([p for f in range(3) for p in rng.sample(range(700), 90)])
    family = np.repeat([0, 1, 2], 90)
    order = suffix.Suffixes(np.frombuffer(data, np.uint8)).merge_sort(at, family)
    for f in range(3):
        mine = [data[at[i] : at[i] + 100] for i in order if family[i] == f]
        assert mine == sorted(mine) and len(mine) == 90


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    got = {(r["doc_id"], r["n_bytes"]): r for r in suffix.remove_repeats(docs).collect()}
    assert suffix.remove_repeats(docs).count() == docs.count()
    assert got[(3, 0)]["spans"] == [] and got[(4, 0)]["spans"] == [] and (None, 10) in got
    assert bytes(got[(8, 180000)]["kept"]) == b"ab cd ef " * 11 + b"a" * 0 + b"ab cd ef "[:0] or len(got[(8, 180000)]["spans"]) == 1
    twice = spark.createDataFrame([(1, "ab" * 100 + "x"), (1, "ab" * 100 + "x"), (1, "ab" * 100 + "y"), (2, "q" + "ab" * 100)], "doc_id long, text string")
    sizes = sorted((r["doc_id"], len(r["kept"])) for r in suffix.remove_repeats(twice).collect())
    assert sizes[0][1] + 0 < 201 and sizes[3][0] == 2 and sizes[3][1] == 1
    assert suffix.remove_repeats(no_docs(spark)).count() == 0
