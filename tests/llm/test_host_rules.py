import random

import numpy as np
from helpers import clashing, no_docs, odd_docs

from lexlake.llm import host_rules as h


def brute_repeat(words):
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    return len({p for i, w in enumerate(wins) if wins.count(w) > 1 for p in range(i, i + 8)})


def test_repeated_words_against_brute_force(monkeypatch):
    rng = random.Random(3)
    cases = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(40))] for _ in range(300)]
    cases += [[b"x"] * n for n in range(12)] + [[str(i).encode() for i in range(20)]]
    for words in cases:
        assert h.repeated_words(words) == brute_repeat(words)
    monkeypatch.setattr(h, "_MIX", np.uint64(0))  # every window then has one hash
    for words in cases[:100]:
        assert h.repeated_words(words) == brute_repeat(words)


def test_hosts_shrink_and_reject(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, "fine") for i in range(90)] + [(100 + i, "short", "bad") for i in range(60)] + [(200 + i, good, "bad") for i in range(5)]
    rows += [(300, "short", "rare"), (301, good, "new")] + [(400 + i, good if i % 9 else "", f"h{i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in h.host_rules(df).collect()}
    assert got[1]["kept"] and not got[100]["kept"] and not got[200]["kept"] and not got[200]["base_failed"]
    assert got[301]["kept"] and 0 < got[301]["host_rate"] < 0.5 and got[300]["host_rate"] < 1


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    rows = h.host_rules(docs, host="source").collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_words"] == 0 and by[3]["base_failed"] and not by[3]["kept"]
    assert by[9]["word_chars"] == len("".join("É 日本語 ß́ \U0001f600 id1ot <s> [INST] ~".split(" "))) and by[9]["n_symbols"] == 2
    assert by[None]["host"] is None and by[8]["n_repeat_words"] == 60000
    assert h.host_rules(no_docs(spark)).count() == 0
