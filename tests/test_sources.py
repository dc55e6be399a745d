import json

import pytest
from pyspark.sql import functions as F

from lexlake.operators import evaluate, report
from lexlake.operators.joins import duplicate_content
from lexlake.plans import assemble, curate, judge
from lexlake.sources import files, markup


def test_delimited_cells(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id\tname\tnote\n1\tNA\t\n2\tnull\t"two\nlines ""q"""\n3\tnan\tx\n', encoding="utf-8")
    df = files.read_delimited(spark, str(tmp_path / "t.csv"), "id int, name string, note string")
    got = [tuple(r) for r in df.orderBy("id").collect()]
    assert got == [(1, "NA", None), (2, "null", 'two\nlines "q"'), (3, "nan", "x")]
    files.write_delimited(df, str(tmp_path / "out"), sep=",")
    back = files.read_delimited(spark, str(tmp_path / "out"), df.schema, sep=",")
    assert sorted(tuple(r) for r in back.collect()) == got


def test_envelope_in_several_documents(spark, tmp_path):
    df = spark.range(25).select("id", F.when(F.col("id") > 3, "é").alias("x"))
    files.write_envelope(df, str(tmp_path / "e"), {"description": "d"}, rows=4)
    docs = [json.loads(x) for p in (tmp_path / "e").glob("part*") for x in p.read_text().splitlines()]
    assert len(docs) > 3 and all(d["metadata"] == {"description": "d"} for d in docs)
    assert all(len(d["data"]) <= 4 for d in docs)
    assert sorted(files.read_envelope(spark, str(tmp_path / "e"), df.schema).collect()) == sorted(df.collect())
    wide = spark.range(25000).coalesce(1)  # more than one document in a file
    files.write_envelope(wide, str(tmp_path / "w"), {"description": "d"})
    assert files.read_envelope(spark, str(tmp_path / "w"), wide.schema).count() == 25000


def test_delimited_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\textra\tname\n1\te\tn1\n2\t\t\n")
    rows = files.read_delimited(spark, str(tmp_path / "a.csv"), "name string, id int").collect()
    assert [tuple(r) for r in rows] == [("n1", 1), (None, 2)]
    with pytest.raises(ValueError, match="no column other"):
        files.read_delimited(spark, str(tmp_path / "a.csv"), "id int, other string")


def test_runs_with_unlike_columns(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\n1,x\n")
    (tmp_path / "two.csv").write_text("b,extra,a\ny,e,2\n")
    (tmp_path / "three.csv").write_text("b\nz\n")
    schema = spark.createDataFrame([], "a int, b string").schema
    rows = files.read_runs(spark, str(tmp_path), schema).collect()
    assert sorted(tuple(r) for r in rows if r["a"]) == [(1, "x", "one"), (2, "y", "two")]
    assert [(r["a"], r["b"], r["run"]) for r in rows if not r["a"]] == [(None, "z", "three")]


def test_envelope_document_written_elsewhere(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"metadata": {"v": "1"}, "data": [{"a": 1, "b": None}, {"a": 2, "b": ["x"]}]}, indent=2))
    schema = spark.createDataFrame([], "a int, b array<string>").schema
    assert [tuple(r) for r in files.read_envelope(spark, str(tmp_path / "d.json"), schema).collect()] == [(1, None), (2, ["x"])]


def test_text_records_drop_blank(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"text": " a "}\n{"text": "  "}\n{"other": 1}\n')
    assert [r["text"] for r in files.read_text_records(spark, str(tmp_path / "t.jsonl")).collect()] == ["a"]
    assert files.read_text_records(spark, str(tmp_path / "t.jsonl"), drop_blank=False).count() == 3


def test_runs_are_named_by_file_stem(spark, tmp_path):
    for name, n in (("m_base_results_20260410_091638", 2), ("m two", 1)):
        (tmp_path / f"{name}.csv").write_text("task_name,is_correct\n" + "t,1\n" * n)
    runs = files.read_runs(spark, str(tmp_path / "*.csv"), "task_name string, is_correct int")
    assert {tuple(r) for r in runs.groupBy("run").count().collect()} == {("m_base_results_20260410_091638", 2), ("m two", 1)}


def test_copied_result_files_are_reported(spark, tmp_path):
    for name, body in (("a.csv", "x"), ("b.csv", "x"), ("c.csv", "y")):
        (tmp_path / name).write_text(body)
    hashes = files.file_hashes(spark, str(tmp_path / "*.csv"))
    assert [(r["file_name"], r["first_id"]) for r in duplicate_content(hashes, "file_name", "content").collect()] == [("b.csv", "a.csv")]


def test_summaries_to_scores_and_total(spark, tmp_path):
    scores = {"t1": 0.82, "t2": 0.0, "t3": 0.54}
    doc = {
        "model_name": "m", "model_path": "p", "evaluation_date": "2026-04-10T09:16:38.494345", "cole_score": 0.4533,
        "summary": {"total_tasks": 5, "completed_tasks": 3, "failed_tasks": 2}, "task_scores": scores, "tasks_predictions": [{"t1": ["1"]}],
    }
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=2))
    df = files.read_summaries(spark, str(tmp_path / "*.json"))
    assert df.first()["evaluation_date"].year == 2026
    long = report.scores_long(df)
    assert {r["task_name"]: r["score"] for r in long.collect()} == scores
    assert round(evaluate.total_macro(long, "model_name").first()["macro"], 4) == doc["cole_score"]
    done = evaluate.run_completeness(long, df, ["t1", "t2", "t3", "t4", "t5"], "model_name", "task_name").first()
    assert tuple(done) == ("m", 5, 3, 2)


def test_recorded_scores_win(spark):
    a = spark.createDataFrame([("m", "t1", 0.5), ("m", "t2", 0.1)], "model string, task string, score double")
    b = spark.createDataFrame([("m", "t1", 0.9), ("n", "t1", 0.3)], "model string, task string, score double")
    got = {tuple(r) for r in evaluate.merge_scores(a, b, ["model", "task"]).collect()}
    assert got == {("m", "t1", 0.5, "recorded"), ("m", "t2", 0.1, "recorded"), ("n", "t1", 0.3, "computed")}


def test_nested_dictionary(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        '<model><c id="1" name="A &amp; B"><c id="2" name="in > side"><![CDATA[<c id="9" name="no"/>]]></c>'
        '<!-- <c id="8" name="no"/> --><c name=\'three\' id="3"/></c><cc id="7" name="no"/><c id="1" name="last"/></model>'
    )
    got = assemble.dictionary_of(spark, str(tmp_path / "d.xml"), "c")
    assert {tuple(r) for r in got.collect()} == {("1", "last"), ("2", "in > side"), ("3", "three")}


def test_report_round_trip_and_heat_cells(spark, tmp_path):
    scores = spark.createDataFrame([("t1", "m_base", 0.25), ("t1", "m_fl", 1.0), ("t2", "m_fl", 0.125)], "task string, model string, score double")
    runs = ["m_fl", "m_base"]
    matrix = report.score_matrix(scores, "task", "model", runs)
    totals = spark.createDataFrame([(0.5625, None)], "m_fl double, m_base double")
    lines = report.markdown_rows(matrix, "task", runs, totals, key_title="Task", total_title="SCORE")
    markup.write_markdown(lines, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part*"))
    assert text.splitlines() == [
        "| Task | m_fl | m_base |", "| :--- | :---: | :---: |", "| **t1** | 100.00% | 25.00% |",
        "| **t2** | 12.50% | - |", "| **SCORE** | **56.25%** | **0.00%** |",
    ]
    wanted = spark.createDataFrame([("fl",), ("m_base",), ("other",)], "w string")
    cells = report.heat_cells(markup.read_markdown_table(spark, str(tmp_path / "r")), wanted, "w")
    got = {(r["row_name"], r["w"]): r["value"] for r in cells.collect()}
    assert got["t1", "fl"] == 100.0 and got["t2", "m_base"] == 0.0 and got["SCORE", "fl"] == 56.25 and got["t1", "other"] == 0.0


def test_first_header_wins(spark):
    df = spark.createDataFrame([(["Task", "src10", "src1"], "src1"), (["Task", "rc"], "src1"), (["Task"], "x")], "h array<string>, w string")
    assert [r[0] for r in df.select(report.match_headers(F.col("h"), F.col("w"))).collect()] == ["src10", "rc", None]


@pytest.fixture(scope="module")
def network(tmp_path_factory):
    """A small lexical network in its file layout."""
    d = tmp_path_factory.mktemp("net")
    put = lambda name, text: (d / name).write_text(text, encoding="utf-8")
    put("01-lsnodes.csv", "id\tentry\tlexnum\tstatus\t%\nn1\te1\tI.1\t1\t0.5\nn2\te2\t\t2\t\nn3\te9\tI\t0\t1\n")
    put("02-lsentries.csv", "id\taddtoname\tname\ne1\tse \tlaver\ne2\t\tmot\n")
    put("05-lsgramcharac-model.xml", '<model><characteristic id="g1" name="POS"><characteristic id="g2" name="verbe"/></characteristic><characteristic id="g3" name="rare"/></model>')
    put("06-lsgramcharac-rel.csv", "node\tusagenote\tusagenotevars\tPOS\nn1\t(g3,g9)\tv\tg2\nn2\t()\t\tg8\nn2\t\t\tg1\n")
    put("13-lsdef.csv", "node\tdef_HTML\tdef_XML\nn1\t<p>Définition</p> <p>l' eau ( x )</p>\t<df><actantpos><tc>$1 <b>est</b> un</tc></actantpos></df>\n")
    put("14-lslf-model.xml", '<model><lexicalfunction id="f1" name="Syn" linktype="pa"/><x><lexicalfunction id="f2" name="Anti" linktype="pa"/></x></model>')
    put("15-lslf-rel.csv", "source\tlf\ttarget\nn1\tf2\tn2\nn1\tf1\tn9\nn2\tf7\tn1\nn1\tf1\tn2\n")
    put("17-lsex.csv", "id\tstatus\tcontent\nx1\t0\t<i>Il se</i> lave .\nx2\t0\tUn mot .\n")
    put("18-lsex-rel.csv", "node\texample\toccurrence\tposition\nn1\tx2\t(0;2)\t2\nn1\tx1\t(6;10)\t1\nn1\tx1\t(0;1)\t3\nn2\tx7\t\t1\nn2\tx2\t(3;6)\t\n")
    return str(d)


def test_network_is_assembled(spark, network):
    rows = assemble.read_network(spark, network).collect()
    by = {}
    for r in rows:
        by.setdefault(r["node_id"], []).append(r)
    n1 = by["n1"][0]
    assert (n1["name"], n1["POS"], n1["usagenote"], n1["definition"], n1["actants"]) == ("se laver", "verbe", ["rare", "g9"], "l'eau (x)", ["$1 est un"])
    assert [tuple(x) for x in n1["lf_dict"]] == [("Anti", "pa", "mot"), ("Syn", "pa", None), ("Syn", "pa", "mot")]
    assert [tuple(x) for x in n1["examples"]] == [("Un mot .", "(0;2)", 2), ("Il se lave .", "(6;10)", 1)]
    assert len(by["n2"]) == 2 and {r["POS"] for r in by["n2"]} == {None, "POS"}
    n2 = by["n2"][0]
    assert [tuple(x) for x in n2["lf_dict"]] == [(None, None, "se laver")]
    assert [tuple(x) for x in n2["examples"]] == [(None, None, 1)]
    n3 = by["n3"][0]
    assert (n3["name"], n3["POS"], n3["lf_dict"], n3["examples"]) == (None, None, None, [])
    assert [len(v) for v in (by["n1"], by["n3"])] == [1, 1]


def test_curation_from_records(spark):
    lf = lambda i: [("Syn", f"t{i % 7}"), ("Anti", f"u{i % 5}"), ("Rare", "x"), ("Syn", None)]
    rows = [(i, f"w{i % 60}", "n." if i % 11 else None, lf(i)[: 3 + i % 2], [("il y a un mot ici", "(9;12)", 1)] if i % 13 else []) for i in range(600)]
    rows.append((900, "w1", "n.", [("Rare", "z")], [("a", "b", 1)]))
    schema = "id int, name string, POS string, lf_dict array<struct<lexical_function:string,target:string>>, examples array<struct<text:string,occurrence:string,position:int>>"
    df = spark.createDataFrame(rows, schema)
    settings = curate.CurationSettings(at_least=601, budget=90, floor=5, excluded=("Rare",))
    assert curate.curate(df, "id", settings).count() <= 90
    settings = curate.CurationSettings(at_least=600, budget=90, floor=5, excluded=("Rare",))
    done = curate.curate(df, "id", settings).collect()
    assert len(done) == 90 and {r["lexical_function"] for r in done} == {"Syn", "Anti"}
    assert all(r["POS"] and r["targets"] and r["example"] for r in done)
    unseen = {r["name"] for r in done if r["split"] == "unseen"}
    assert unseen and not unseen & {r["name"] for r in done if r["split"] != "unseen"}
    want = {}
    for _, name, pos, rel, ex in rows:
        for f, t in rel:
            if pos and ex and t and f in ("Syn", "Anti"):
                want.setdefault(f"{name}||{pos}||{f}", set()).add(t)
    assert all(set(r["targets"]) == want[r["group_id"]] and len(r["targets"]) == len(want[r["group_id"]]) for r in done)


def test_templates_and_judged_report(spark, tmp_path):
    patterns = {"patterns": [{"lf": "Syn", "free_pattern": ["Syn de <W> ?", "Autre <W> ?"], "one_shot": "S"}, {"lf": "Anti", "free_pattern": ["Anti de <W> ?"]}]}
    (tmp_path / "p.json").write_text(json.dumps(patterns))
    templates = markup.read_templates(spark, str(tmp_path / "p.json")).withColumnRenamed("lf", "lexical_function")
    assert {(r["lexical_function"], r["pattern_no"], r["one_shot"]) for r in templates.collect()} == {("Syn", 1, "S"), ("Syn", 2, "S"), ("Anti", 1, "")}
    items = spark.createDataFrame([("mot", "Syn", ["terme"], "ctx"), ("bon", "Anti", ["mauvais"], None), ("x", "Zip", ["y"], None)], "name string, lexical_function string, targets array<string>, example string")

    def load():
        return lambda prompts: prompts.map(lambda p: "Terme. Suite" if "Exemple" in p else "un mauvais, choix")

    results = judge.judged(items, templates, load, "echo")
    assert results.count() == (2 + 1) * 4
    lines = judge.report(results, ["echo"]).orderBy("section", "sort_key")
    assert [r["line"] for r in lines.collect()] == [
        "| Relation | echo |", "| :--- | :---: |", "| **Anti** | 100.0% |", "| **Syn** | 50.0% |", "| **TOTAL** | **66.7%** |",
    ]


def test_splits_are_written_apart(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "train")], "g string, split string")
    files.write_splits(df, str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"split=train", "split=val"}
    assert sorted(tuple(r) for r in files.read_splits(spark, str(tmp_path / "s")).collect()) == [("a", "train"), ("b", "val"), ("c", "train")]


def test_block_readers_get_batches_bounded_in_rows_and_bytes(spark):
    from lexlake.sources import splits

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    import pyarrow as pa

    texts = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', if(id < 2000, 10000, 10)) as value")
    got = splits._map(texts, sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 4000
    assert max(r["n"] for r in got) <= 1000 and max(r["bytes"] for r in got) <= 3 << 20


def test_curation_writes_no_example_per_relation(spark, monkeypatch):
    from lexlake.plans import curate

    seen, written = {}, curate.written

    def record(df, label):
        seen[label] = df.columns
        return written(df, label)

    monkeypatch.setattr(curate, "written", record)
    relation = [("R", f"t{k}") for k in range(5)]
    rows = [(i, f"w{i % 20}", "n", relation, [(f"text of {i}", "(0;4)", 1)]) for i in range(40)] + [(40, "w40", "n", relation, [])]
    schema = "id long, name string, POS string, lf_dict array<struct<lexical_function:string,target:string>>, examples array<struct<text:string,occurrence:string,position:int>>"
    settings = curate.CurationSettings(at_least=1, budget=100, floor=1)
    done = curate.curate(spark.createDataFrame(rows, schema), "id", settings)
    assert done.columns == ["name", "POS", "lexical_function", "example", "group_id", "split", "targets"]
    assert {r["name"]: r["example"] for r in done.collect()} == {f"w{i}": f"text of {i}" for i in range(20)}
    assert "example" not in seen["items"] + seen["groups"]
