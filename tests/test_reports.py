import json

from pyspark.sql import functions as F

from lexlake.functions.text import list_text, parse_list, percent_text
from lexlake.operators import evaluate, profile
from lexlake.plans import reports
from lexlake.sources import files

ROWS = "run string, task_name string, prediction string, ground_truth string, is_correct int"
RESULTS = "run string, lexical_functions string, targets string, answer string, prediction string, EM int, CM int"


def summary(path, name, total, scores, **more):
    path.write_text(json.dumps({"model_name": name, "cole_score": total, "task_scores": scores, **more}, indent=1))


def lines(df):
    return [r["line"] for r in reports.numbered(df).orderBy("line_no").collect()]


def test_summary_stands_for_its_run_and_a_relabelled_task_for_either(spark, tmp_path):
    for run, args in {"a": ("A", 0.5, {"t": 0.6, "u": 0.4}), "b": ("B", 0.9, {"t": 0.9, "nli": 0.9}), "c": ("C", None, {})}.items():
        summary(tmp_path / f"{run}.json", *args)
    rows = [
        ("a", "t", "1", "1", 1), ("a", "w", "1", "1", 1),  # the summary hides both
        ("b", "nli", " 0 ", "Well, YES", 0), ("b", "nli", "2", "no", 1), ("b", "nli", "2", None, 0), ("b", "nli", None, "unclear", 0),
        ("d_x_20260102_111213_out", "t", "1", "1", 1), ("d_x_20260102_111213_out", "t", "0", "1", 0), ("d_x_20260102_111213_out", "nli", "0", "yes", 1),
        ("e", "t", "1", "1", None),  # no summary and no marks: no run
        ("c", "t", "1", "1", 1),
    ]
    df = spark.createDataFrame(rows, ROWS)
    summaries = files.read_summaries(spark, str(tmp_path / "*.json"))
    got = lines(reports.task_report(summaries, df, "nli", "_out"))
    # b: 2 of 4 right by the verdicts, total again from its tasks; d: nothing to relabel.
    assert got == [
        "| Task | d_x | B | A | C |",
        "| :--- | :---: | :---: | :---: | :---: |",
        "| **nli** | 100.00% | 50.00% | - | - |",
        "| **t** | 50.00% | 90.00% | 60.00% | - |",
        "| **u** | - | - | 40.00% | - |",
        "| **TOTAL** | **75.00%** | **70.00%** | **50.00%** | **0.00%** |",
    ]


def test_more_models_than_any_fixed_list(spark):
    rows = spark.range(300).select(
        F.concat(F.lit("run"), (F.col("id") % 30).cast("string")).alias("run"), F.lit("t").alias("task_name"),
        F.lit("1").alias("prediction"), F.lit("1").alias("ground_truth"), (F.col("id") % 30 < F.col("id") / 10).cast("int").alias("is_correct"),
    )
    none = spark.createDataFrame([], "run string, model_name string, cole_score double, task_scores map<string,double>")
    head = lines(reports.task_report(none, rows, "nli", "_x"))[0]
    assert len(head.split(" | ")) == 31


def test_recorded_runs_take_no_computed_scores(spark):
    schema = "model string, task string, score double"
    a = spark.createDataFrame([("m", "t1", 0.5), ("k", "t1", None)], schema)
    b = spark.createDataFrame([("m", "t2", 0.9), ("n", "t1", 0.3), ("k", "t1", 0.2)], schema)
    over = spark.createDataFrame([("m", "t3", 0.1), ("n", "t1", 0.0)], schema)
    got = {tuple(r) for r in evaluate.merge_scores(a, b, ["model", "task"], over).collect()}
    assert got == {("m", "t1", 0.5, "recorded"), ("m", "t3", 0.1, "relabelled"), ("n", "t1", 0.0, "relabelled"), ("k", "t1", 0.2, "computed")}


def test_relation_report_matches_anew_where_it_can(spark):
    rows = [
        ("x", "R1", "['Cat', \"dog's\"]", "The cat. assistant", None, 0, 0), ("x", "R1", None, "cat", None, 1, 1), ("x", None, "['a']", "a", None, 0, 0),
        ("y", "R2", None, "cat", None, 1, 1), ("y", "R2", None, None, None, 0, 0),
        ("z", "R1", "['q']", None, None, None, None), ("w", "R1", "plain", None, "PLAIN", 0, 0),
    ]
    got = lines(reports.relation_report(spark.createDataFrame(rows, RESULTS)))
    assert got == [
        "| Relation | w | x | y | z |",
        "| :--- | :---: | :---: | :---: | :---: |",
        "| **R1** | 100.0% | 50.0% | 0.0% | 0.0% |",
        "| **R2** | 0.0% | 0.0% | 50.0% | 0.0% |",
        "| **TOTAL** | **100.0%** | **66.7%** | **50.0%** | **0.0%** |",
    ]


def test_result_records_come_back(spark, tmp_path):
    judged = spark.createDataFrame(
        [("w", "n", "R1", 'say "<W>",\nplease', ["it's", "b\\c", None, "d\ne"], True, False, "p\n q", " It's ", 1, 1, "m+1 #2")],
        "name string, pos string, lexical_function string, pattern string, targets array<string>, k boolean, s boolean, prompt string, answer string, EM int, CM int, model string",
    )
    rows = reports.result_rows(judged)
    # Columns of a result record.
    assert rows.columns == ["word", "pos", "lexical_functions", "pattern", "targets", "k", "s", "prompt", "answer", "EM", "CM", "run"]
    files.write_results(rows, str(tmp_path / "out"))
    back = files.read_runs(spark, str(tmp_path / "out"), rows.drop("run").schema)
    assert back.select(rows.columns).collect() == rows.collect()
    assert back.select(parse_list(F.col("targets")).alias("t")).first()["t"] == ["it's", "b\\c", "d\ne"]
    assert spark.range(1).select(list_text(F.array().cast("array<string>")).alias("t")).first()["t"] == "[]"


def test_errors_and_predictions_of_summaries(spark, tmp_path):
    summary(
        tmp_path / "r.json", "m", 0.1, {"t": 0.1},
        tasks_predictions=[{"t": ["1", "a b"]}, {"u": []}], tasks_metrics=[{"t": {"acc": {"acc": 0.1}}}, {"u": {"error": "no memory"}}],
    )
    path = str(tmp_path / "*.json")
    assert [tuple(r) for r in files.read_task_errors(spark, path).collect()] == [("r", "m", "u", "no memory")]
    assert [tuple(r) for r in files.read_task_predictions(spark, path).collect()] == [("r", "m", "t", 0, "1"), ("r", "m", "t", 1, "a b")]


def test_all_combinations(spark):
    df = spark.createDataFrame([(i, v) for i in range(30) for v in ("ab" if i % 3 else "b")], "i int, v string")
    assert {tuple(r) for r in profile.combination_counts(df, "i", "v", 1).collect()} == {("a + b", 20), ("b", 10)}


def test_shares_just_above_a_tie_round_up(one):
    assert one({"v": 0.6125}, percent_text(F.col("v"), 1), "v double") == "61.3%"  # 61.25000000000001
    assert one({"v": 0.125}, percent_text(F.col("v"), 0), "v double") == "12%"
