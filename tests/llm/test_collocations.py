import random
import re
from collections import Counter

import numpy as np
from helpers import clashing, no_docs, odd_docs

from lexlake.llm import collocations as c


def brute(rows, least, words=5, top=2000):
    """The whole definition over plain lists, with Python's unbounded integers."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, words + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = set()
    for (lang, p), a in found.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                if a >= found[lang, p[i : i + size]]:
                    inside.add((lang, p[i : i + size]))
    out = {}
    for (lang, p), a in found.items():
        if (lang, p) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    rows = []
    for lang, phrases in out.items():
        for rank, (score, a, phrase, l, r, total) in enumerate(sorted(phrases)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, total, -score))
    return sorted(rows)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "é", "日本", "a", "a", "x" * 40, "\x00", "\x1c", "t-1"]
    rows = []
    for _ in range(n):
        parts = [rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n"]) + rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "en", "en", "fr", None, ""]), "".join(parts) + rng.choice(["", " new york times square", " a a a a a a"])))
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(c, "DENSE", 40)
    rows = texts(3, 500)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    for top in (2000, 11):
        got = sorted(tuple(r) for r in c.collocations(docs, least=12, top=top).collect())
        assert got == brute(rows, 12, top=top)


def test_chunks_of_every_size_agree(spark, monkeypatch):
    rows = texts(5, 120)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    named = docs.selectExpr("coalesce(lang, 'und') as lang", "cast(text as binary) as text")
    assert c._word_chunks(named, 3).where("bucket = -1").count() == 4  # one per language: all fit one chunk
    for places in (1 << 20, 100):
        monkeypatch.setattr(c, "BUCKET_PLACES", places)
        assert sorted(tuple(r) for r in c.collocations(docs, least=3, words=3).collect()) == brute(rows, 3, words=3)


def test_tiles_count_what_a_dictionary_counts(monkeypatch):
    rng = np.random.default_rng(2)
    for dense in (1, 50, 10**9):
        monkeypatch.setattr(c, "DENSE", dense)
        left, right = (np.minimum(rng.zipf(1.3, 5000), 10**6).astype(np.int64) for _ in range(2))
        code = (left << c._RANK_BITS) + right
        found, times, place = c.count_pairs(code)
        assert dict(zip(found.tolist(), times.tolist())) == Counter(code.tolist()) and (found[place] == code).all()
        again, twice, _ = c.count_pairs(np.concatenate((found, found)), np.concatenate((times, times)))
        assert dict(zip(again.tolist(), twice.tolist())) == {k: 2 * v for k, v in Counter(code.tolist()).items()}
    assert all(len(x) == 0 for x in c.count_pairs(np.zeros(0, np.int64)))
    numbers = np.array([0, 1, -5, 2**40], np.int64)
    assert (c.unplanes(c.planes(numbers)) == numbers).all()


def test_scores_beyond_64_bits(spark):
    big = 10**15
    row = spark.createDataFrame([([9 * 10**14, 7 * 10**14], [8 * 10**14, 7 * 10**14], 7 * 10**14, big * 9000)], "heads array<long>, tails array<long>, a long, n long")
    cut = row.select(c._lowest_cut(2).alias("c")).first()["c"]
    assert tuple(cut) == (1000 * 7 * 10**14 * big * 9000 // (9 * 10**14 * 8 * 10**14), 1, 9 * 10**14, 8 * 10**14)


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    got = [tuple(r) for r in c.collocations(docs).collect()]
    assert sorted(got) == brute([(r["lang"], r["text"]) for r in docs.collect()], 100) and got
    assert c.collocations(no_docs(spark)).collect() == []
    assert c.collocations(odd_docs(spark).where("text = ''")).collect() == []
