from pyspark.sql import functions as F

from lexlake.operators.joins import corpus_filter
from lexlake.streaming.corpus import stream_corpus


def docs(spark, start, n):
    return spark.range(start, start + n).select("id", F.concat(F.lit("  x"), F.repeat(F.lit("é"), (F.col("id") % 120).cast("int")), F.lit("\n")).alias("text"))


def test_stream_equals_batch_and_goes_on_where_it_stopped(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs(spark, 0, 300).write.parquet(src)
    schema = docs(spark, 0, 1).schema
    stream_corpus(spark, src, schema, out, max_len=80)
    docs(spark, 300, 200).write.mode("append").parquet(src)
    stream_corpus(spark, src, schema, out, max_len=80)
    stream_corpus(spark, src, schema, out, max_len=80)
    want = sorted(tuple(r) for r in corpus_filter(docs(spark, 0, 500), "text", 50, 80).collect())
    assert sorted(tuple(r) for r in spark.read.schema(schema).parquet(out).collect()) == want


def test_stream_stops_after_n(spark, tmp_path):
    docs(spark, 0, 300).write.parquet(str(tmp_path / "in"))
    stream_corpus(spark, str(tmp_path / "in"), docs(spark, 0, 1).schema, str(tmp_path / "out"), n=40)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 40 and got.where(F.length("text") < 50).count() == 0


def test_shuffled_batches_hold_the_same_texts(spark, tmp_path):
    docs(spark, 0, 300).coalesce(3).write.parquet(str(tmp_path / "in"))
    schema = docs(spark, 0, 1).schema
    stream_corpus(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), shuffle_seed=42, row_id="id", max_files=1)
    got = spark.read.schema(schema).parquet(str(tmp_path / "out"))
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in corpus_filter(docs(spark, 0, 300), "text").collect())


def ids(spark, out):
    return [r["id"] for r in spark.read.parquet(out).orderBy("step").collect()]


def many_files(spark, tmp_path, files=6, rows=50):
    src = str(tmp_path / "in")
    for i in range(files):
        long_enough(spark, i * rows, rows).coalesce(1).write.mode("append").parquet(src)
    return src


def long_enough(spark, start, n):
    return spark.range(start, start + n).select("id", F.concat(F.repeat(F.lit("y"), 60), F.col("id").cast("string")).alias("text"))


def test_n_counts_over_batches_and_runs(spark, tmp_path):
    src, out = many_files(spark, tmp_path), str(tmp_path / "out")
    schema = long_enough(spark, 0, 1).schema
    stream_corpus(spark, src, schema, out, n=120, row_id="id", max_files=1)
    first = ids(spark, out)
    assert len(set(first)) == 120
    long_enough(spark, 300, 50).write.mode("append").parquet(src)
    stream_corpus(spark, src, schema, out, n=120, row_id="id", max_files=1)
    assert ids(spark, out) == first


def test_buffer_mixes_batches_and_loses_nothing(spark, tmp_path):
    src, out = many_files(spark, tmp_path), str(tmp_path / "out")
    schema = long_enough(spark, 0, 1).schema
    stream_corpus(spark, src, schema, out, shuffle_seed=1, row_id="id", max_files=1, buffer=70)
    got = spark.read.parquet(out)
    assert sorted(r["id"] for r in got.collect()) == list(range(300))
    per = {r["step"]: r["count"] for r in got.groupBy("step").count().collect()}
    assert per == {2: 30, 4: 50, 6: 50, 8: 50, 10: 50, 11: 70}
    assert got.where("step = 6").select(F.floor(F.col("id") / 50)).distinct().count() > 1
    # More files in a later run: the buffer starts empty, nothing comes twice.
    long_enough(spark, 300, 90).coalesce(1).write.mode("append").parquet(src)
    stream_corpus(spark, src, schema, out, shuffle_seed=1, row_id="id", max_files=1, buffer=70)
    assert sorted(ids(spark, out)) == list(range(390))


def test_restart_in_the_middle_gives_the_same(spark, tmp_path, monkeypatch):
    import pytest

    from lexlake.streaming import corpus

    src = many_files(spark, tmp_path)
    schema = long_enough(spark, 0, 1).schema
    options = dict(shuffle_seed=3, row_id="id", max_files=1, buffer=70, n=200)
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    stream_corpus(spark, src, schema, whole, **options)
    real = corpus._Pool.take

    def failing(self, batch, batch_id):
        real(self, batch, batch_id)
        if batch_id == 3:  # the step is written, its commit is not
            raise RuntimeError("lost")

    monkeypatch.setattr(corpus._Pool, "take", failing)
    with pytest.raises(Exception, match="lost"):
        stream_corpus(spark, src, schema, broken, **options)
    monkeypatch.undo()
    stream_corpus(spark, src, schema, broken, **options)
    a, b = (sorted((r["step"], r["id"]) for r in spark.read.parquet(x).collect()) for x in (whole, broken))
    assert a == b and len(a) == 200 == len({i for _, i in a})


def test_text_and_json_lines_sources(spark, tmp_path):
    lines = [f"  line {i} " + "z" * 60 for i in range(20)] + ["short", ""]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("\n".join(lines) + "\n")
    stream_corpus(spark, str(tmp_path / "t"), None, str(tmp_path / "t_out"), fmt="text", shuffle_seed=5)
    got = spark.read.schema("text string").parquet(str(tmp_path / "t_out"))
    assert sorted(r["text"] for r in got.collect()) == sorted(x.strip() for x in lines[:20])
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text("\n".join('{"text": "%s", "k": %d}' % (x, i) for i, x in enumerate(lines)) + "\n{bad\n")
    stream_corpus(spark, str(tmp_path / "j"), spark.createDataFrame([], "text string, k int").schema, str(tmp_path / "j_out"), fmt="json", n=7, row_id="k")
    got = spark.read.schema("text string, k int").parquet(str(tmp_path / "j_out")).collect()
    assert len(got) == 7 == len({r["k"] for r in got}) and all(r["text"] == lines[r["k"]].strip() for r in got)


def test_no_files_give_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = long_enough(spark, 0, 1).schema
    stream_corpus(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), n=5)
    assert spark.read.schema(schema).parquet(str(tmp_path / "out")).count() == 0
