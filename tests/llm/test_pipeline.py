import corpus_pipeline as p
import pytest
from helpers import odd_docs
from pyspark.sql import functions as F

from lexlake.llm import toxicity

FOLDER = "/root/testdata/sf0.01"

# Labelled toxic documents of that folder without a learnable sign: none of their words or beginnings of words stands in five toxic
# documents of the sample and (nearly) only there, so nothing tells them from clean ones.
SIGNLESS = {100, 259, 269, 351, 417, 694, 881, 908, 995}
INNER = ("k", "code", "times", "code_", "head_", "head_code_", "times_", "__head", "__code", "__times", "__n", "__u", "__source", "__steps", "source_", "steps_",
         "bm_hit", "bm_words", "bm_text", "bm_items", "bm_spans", "tox_score", "copy_no", "mix_key", "mix_rate", "node", "root", "key", "part", "start")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_stages_keep_columns_and_take_effect(spark, docs, tmp_path):
    from test_decontaminate import brute
    from test_near_text import brute_heads

    current, seen = docs, []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, current, FOLDER)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / name))
        seen.append((name, current, spark.read.parquet(str(tmp_path / name))))
        current = seen[-1][2]
    (_, _, calm), (_, _, single), (_, before, clean), (_, unmixed, mixed) = seen

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    toxic = docs.join(labels.where("toxic = 1"), "doc_id", "left_semi")
    kept = {r["doc_id"] for r in calm.join(toxic, "doc_id", "left_semi").collect()}
    assert len(kept - SIGNLESS) <= 0.1 * (toxic.count() - len(SIGNLESS))
    # What the list says is so: none of these texts has a term of the lexicon, plain or hidden.
    model = toxicity.train_toxicity(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    at = [toxicity.FEATURES.index(f) for f in ("log_hits", "log_hidden")]
    for r in docs.where(F.col("doc_id").isin(*SIGNLESS)).collect():
        values = toxicity.features(r["text"].encode(), model.lexicon)
        assert not any(values[k] for k in at), r["doc_id"]
    fine = docs.join(labels.where("toxic = 0"), "doc_id", "left_semi")
    assert fine.join(calm, "doc_id", "left_anti").count() <= 0.01 * fine.count()

    assert sorted(r["doc_id"] for r in single.collect()) == brute_heads([(r["doc_id"], r["text"]) for r in calm.collect()])

    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = {r[0]: r for r in brute([(r["doc_id"], r["text"]) for r in before.collect()], bench)}
    got = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(got) == {i for i, r in want.items() if r[2] == 0 or r[2] < r[1]}
    after = {r[0]: r for r in brute(list(got.items()), bench)}
    assert all(r[2] == 0 and r[1] == want[i][1] - want[i][2] for i, r in after.items())
    assert set(r["doc_id"] for r in mixed.select("doc_id").collect()) <= set(r["doc_id"] for r in unmixed.select("doc_id").collect())


def test_run(spark):
    rows = p.run(spark, FOLDER).collect()
    spans = sorted((r["start"], r["start"] + r["n_tokens"]) for r in rows)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_odd_rows_go_through_every_stage(spark):
    current = odd_docs(spark)
    for name in INNER:
        current = current.withColumn(name, F.lit(name))
    columns = current.columns
    for _, stage in p.STAGES[:-1]:
        current = stage(spark, current, FOLDER)
        assert current.columns == columns
    rows = current.collect()
    assert rows and all(r[name] == name for r in rows for name in INNER)
    p.STAGES[-1][1](spark, current, FOLDER).collect()


def test_own_columns_cost_no_text(spark, docs):
    own = docs.limit(60).withColumn("bm_text", F.lit("own")).withColumn("bm_hit", F.lit(5)).withColumn("bm_words", F.lit(5))
    done = dict(p.STAGES)["decontamination"](spark, own, FOLDER)
    plain = dict(p.STAGES)["decontamination"](spark, docs.limit(60), FOLDER)
    assert sorted((r["doc_id"], r["text"]) for r in done.collect()) == sorted((r["doc_id"], r["text"]) for r in plain.collect())
    assert {(r["bm_text"], r["bm_hit"]) for r in done.collect()} == {("own", 5)}
