import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import clashing, no_docs, odd_docs

from lexlake.llm import near_text as n


def sets_of(texts, shingle=5):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out.append({b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    return out


def brute_heads(rows, least=0.8):
    """Least id of each component; pairs of equal texts or with a Jaccard similarity from ``least`` on are links."""
    sets, root = sets_of([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            low, high = sorted((len(a), len(sets[j])))
            if a == sets[j] or low >= least * high and len(a & sets[j]) >= least * len(a | sets[j]):
                root[find(i)] = find(j)
    heads = {}
    for i, (doc_id, _) in enumerate(rows):
        heads[find(i)] = min(doc_id, heads.get(find(i), doc_id))
    return sorted(heads.values())


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.getrandbits(40)}"
    return " ".join(words)


def test_stage_drops_similar_texts_that_two_bits_miss(spark):
    import corpus_pipeline as p

    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = brute_heads(list(zip(docs["doc_id"], docs["text"], strict=True)))
    stage = dict(p.STAGES)["near_dedup"]
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(r["doc_id"] for r in stage(spark, frame, "/root/testdata/sf0.01").select("doc_id").collect())
    assert got == want


def test_chains_families_and_pairs_against_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):  # a text with slightly and more strongly changed versions
        base = [f"w{rng.getrandbits(30)}" for _ in range(120)]
        texts += [edited(rng, base, c) for c in (0, 0, 1, 2, 3, 4, 6, 9)]
    base = [f"f{i}" for i in range(100)]  # one family, most pairs of it below the bound
    texts += [edited(rng, base, rng.choice([1, 2, 3, 4])) for _ in range(80)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = sorted(r["doc_id"] for r in n.drop_near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_heads(rows)


def counted_pairs(spark, monkeypatch, texts):
    """Rows of all lists of pairs that are compared, and the texts kept."""
    counts, written = [], n.written

    def record(df, label):
        out = written(df, label)
        counts.extend([out.count()] if label == "pairs" else [])
        return out

    monkeypatch.setattr(n, "written", record)
    rows = list(enumerate(texts))
    got = sorted(r["doc_id"] for r in n.drop_near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_heads(rows)
    return sum(counts)


def test_pairs_of_an_unlike_family_grow_with_its_size(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"f{i}" for i in range(100)]
    family = [edited(rng, base, 3) for _ in range(240)]  # pairs of it have similarities of about 0.55 to 0.75
    small = counted_pairs(spark, monkeypatch, family[:120])
    assert counted_pairs(spark, monkeypatch, family) <= 2.6 * small


def test_fingerprints_in_the_gray_index_link_first(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"g{i}" for i in range(2000)]
    texts = [" ".join(base), " ".join(base).upper() + "  \n", edited(rng, base, 1), " ".join(f"h{i}" for i in range(50)), ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "cast(text as binary) as text")
    codes = n._sketches(rows, n.SHINGLE).selectExpr("doc_id as least", "node", "fp", "keys", "bits").where("doc_id <> 1")
    pairs = n._fingerprint_pairs(codes).collect()
    assert {frozenset(p) for p in pairs} == {frozenset(np.array([n.node_of(texts[i].encode()) for i in (0, 2)], np.uint64).view(np.int64).tolist())}


def test_sketch_keeps_pairs_at_the_bound():
    rng = np.random.default_rng(1)
    shared = bands = 0
    for _ in range(300):
        pool = rng.integers(0, 2**63, 120, dtype=np.uint64)
        a, b = np.unique(pool[:108]), np.unique(pool[12:])  # 96 of 120
        (ka, ba), (kb, bb) = n.sketch(a), n.sketch(b)
        bands += bool((ka == kb).any())
        shared += int(np.bitwise_count((ba ^ bb).view(np.uint64)).sum()) <= n.SKETCH_BITS
    assert bands == shared == 300


@pytest.mark.parametrize("rows", [[(3, "a"), (5, "a"), (5, "b")], [(5, "a"), (5, "b")], [(5, "a"), (5, "a"), (5, "b"), (6, "b")]])
def test_repeated_ids_keep_a_row_of_each_component(spark, rows):
    kept = [r["text"] for r in n.drop_near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == ["a", "b"]


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    kept = n.drop_near_texts(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 5, 8, 9]  # null, empty and blank texts are one
    assert n.drop_near_texts(no_docs(spark)).count() == 0
