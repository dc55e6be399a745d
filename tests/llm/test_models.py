import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import clashing, no_docs, odd_docs
from pyspark.sql import functions as F

from lexlake.llm import quality_model, toxicity, trees
from lexlake.llm.queries import op5_quality, op7_toxicity

FOLDER = "/root/testdata/sf0.1"


def labels(folder, name):
    t = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    return dict(zip(t["doc_id"], t[name], strict=True))


@pytest.mark.parametrize("query,name,cut", [(op5_quality, "quality", 0.3), (op7_toxicity, "toxic", 0.5)])
def test_held_out_accuracy(spark, query, name, cut):
    import zlib

    known = labels(FOLDER, name)
    rows = query(spark, FOLDER).collect()
    assert len(rows) == pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id"]).num_rows
    right, total, ones, found = 0, 0, 0, 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
        if r["held_out"] and r["doc_id"] in known:
            total += 1
            right += r["predicted"] == known[r["doc_id"]]
            least = known[r["doc_id"]] == (0 if name == "quality" else 1)
            ones += least
            found += least and r["predicted"] == known[r["doc_id"]]
    # A tenth of the toxic labels here is on documents without any insult.
    assert right / total > 0.97 and found / ones > (0.9 if name == "quality" else 0.85)


def test_rules_as_columns_equal_rules_in_memory(spark):
    rng = np.random.default_rng(1)
    x = rng.random((500, len(quality_model.STATISTICS)))
    y = ((x[:, 1] > 0.4) & (x[:, 3] < 0.7)).astype(np.int64)
    model = quality_model.fit_rules(x, y)
    odds = model.intercept + sum(w * quality_model._holds(x, p) for p, w in model.rules)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(quality_model.STATISTICS))
    got = np.array([r[0] for r in df.select(model.column()).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-odds)))
    assert ((got > 0.5) == y).mean() > 0.97 and 0 < len(model.rules) < 200


def test_isotonic_ascends_and_keeps_the_mean():
    rng = np.random.default_rng(2)
    s = np.round(rng.normal(size=400), 1)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * s))).astype(np.int64)
    xs, ys = trees.isotonic(s, y)
    assert (np.diff(xs) > 0).all() and (np.diff(ys) >= 0).all()
    assert abs(np.interp(s, xs, ys).mean() - y.mean()) < 1e-9


def test_lasso_drops_idle_rules():
    rng = np.random.default_rng(3)
    x = (rng.random((1000, 30)) < 0.5).astype(float)
    _, w = trees.lasso(x, x[:, 4], 0.02)
    assert np.flatnonzero(np.abs(w) > 1e-6).tolist() == [4]


@pytest.mark.parametrize("rows", [[], [(5, 1, 1), (8, 1, 1)], [(5, None, None), (8, 1, 0), (2, 0, 1), (2, 0, 1), (77, 1, 1)]])
def test_few_or_no_labels_and_odd_rows(spark, rows):
    docs = clashing(odd_docs(spark))
    known = spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    scored = quality_model.score_quality(docs, quality_model.train_quality(docs, known)).collect()
    toxic = toxicity.toxicity(docs, known).collect()
    assert len(scored) == len(toxic) == docs.count()
    if not rows:
        assert {r["predicted"] for r in scored} == {1} and {r["predicted"] for r in toxic} == {0}
    none = no_docs(spark)
    assert quality_model.score_quality(none, quality_model.train_quality(none, known)).count() == 0
    assert toxicity.toxicity(none, known).count() == 0


def test_short_toxic_passage_shows_in_a_long_text(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train_toxicity(docs, labels)
    known = docs.join(labels, "doc_id").orderBy("doc_id").select("text", "toxic").limit(2000).collect()
    value = lambda t: float(model.score(np.array([toxicity.features(t.encode(), model.lexicon)]))[0])
    seen = [r["text"] for r in known if r["toxic"] == 1 and value(r["text"]) >= 0.5][:20]
    calm = [r["text"] for r in known if r["toxic"] == 0 and value(r["text"]) < 0.1]
    long = " ".join(w for t in calm for w in t.split())
    words = long.split()[:10_000]
    assert len(seen) >= 5 and len(words) == 10_000 and value(" ".join(words)) < 0.5
    hidden = [value(" ".join([*words[:5000], t, *words[5000:]])) for t in seen]
    assert sum(v >= 0.5 for v in hidden) >= 0.9 * len(seen)


def test_lexicon_bound_counts_words_without_their_beginnings(spark):
    insults = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}{i:03d}xyzuvw" for i in range(150)]
    rows = [(i * 6 + k, f"{w} filler{i}a{k} other{k}b{i}", 1) for i, w in enumerate(insults) for k in range(6)]
    rows += [(10_000 + i, f"calm words number{i} here{i}", 0) for i in range(3000)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    assert {w.encode() for w in insults} <= set(toxicity.learn_lexicon(sample).words)
