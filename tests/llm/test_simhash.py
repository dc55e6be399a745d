import random

import numpy as np
import pytest
import xxhash
from helpers import clashing, no_docs, odd_docs

from lexlake.llm import simhash as s
from lexlake.llm.components import connected_components


def brute_fp(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(codes):
    codes = list(codes)
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(codes):
        for j in range(i):
            if (a ^ codes[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(codes))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(spark):
    df = odd_docs(spark)
    for r in s.fingerprints(df).join(df.select("doc_id", "text"), "doc_id").collect():
        assert r["fp"] == signed(brute_fp(r["text"]))


def clusters(seed, n):
    rng = random.Random(seed)
    codes = {0}
    for _ in range(n):
        c = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 20])):
            codes.add(c)
            for _ in range(rng.choice([1, 2, 3])):
                c ^= 1 << rng.randrange(64)
    return sorted(codes)


@pytest.mark.parametrize("hot", [50_000, 8])
def test_links_against_brute_force(spark, hot):
    codes = clusters(3, 80)
    df = spark.createDataFrame([(signed(c),) for c in codes], "fp long")
    got = {r["node"]: r["root"] for r in connected_components(s.link_fingerprints(df, hot)).collect()}
    want = brute_components(codes)
    groups = {}
    for c, r in zip(codes, want, strict=True):
        groups.setdefault(r, set()).add(got.get(signed(c), signed(c)))
    assert all(len(v) == 1 for v in groups.values())
    assert len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_index_prunes_nothing_it_should_find():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(rng.integers(64))) for _ in range(30)]))
    group = np.zeros(len(codes), np.int64)
    index = s.GrayIndex(codes, group)
    q, o = index.links(np.arange(len(codes)), 2)
    got = set(zip(index.codes[q].tolist(), index.codes[o].tolist(), strict=True))
    want = {(a, b) for a in codes.tolist() for b in codes.tolist() if (a ^ b).bit_count() <= 2}
    assert got == want


def test_component_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[1000 + i] for i in range(400)}) == 1 and len(set(got.values())) == 2


def test_query_against_brute_force(spark):
    from lexlake.llm.queries import op3_simhash
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    codes = [brute_fp(t) for t in docs["text"]]
    roots = brute_components(codes)
    least = {}
    for i, r in zip(docs["doc_id"], roots, strict=True):
        least[r] = min(i, least.get(r, i))
    want = {i: (f"{c:016x}", least[r]) for i, c, r in zip(docs["doc_id"], codes, roots, strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op3_simhash(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    found = s.near_components(docs).collect()
    assert len(found) == docs.count()
    assert {r["component_id"] for r in found if r["fp"] == 0} == {3}  # null, empty and blank texts
    kept = s.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i in ids if i is not None}) and 9 in ids and 4 not in ids and None in ids
    assert s.near_components(no_docs(spark)).count() == 0


A = " ".join(f"apple{i}" for i in range(60))
B = " ".join(f"birch{i}" for i in range(60))


@pytest.mark.parametrize("rows", [[(3, A), (5, A), (5, B)], [(5, A), (5, B)], [(5, A), (5, A), (5, B), (6, B)]])
def test_repeated_ids_keep_a_row_of_each_component(spark, rows):
    kept = [r["text"] for r in s.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == [A, B]
