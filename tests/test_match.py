import random
import re

from pyspark.sql import functions as F

from lexlake.functions import match
from lexlake.operators import evaluate


def plain_label(text, labels):
    """Written anew from the rules, one return per rule."""
    c = text.lower().strip().rstrip(".,!?:")
    rules = [
        [x for x in labels if c == x.lower()],
        [x for x in labels if c.startswith(x.lower())],
        [x for x in labels if re.search(rf"\b{re.escape(x.lower())}\b", c)],
        [x for x in labels if len(x) > 1 and f" {x.lower()} " in f" {c} "],
    ]
    if rules[0] or rules[1]:
        return (rules[0] or rules[1])[0]
    if len(rules[2]) == 1:
        return rules[2][0]
    return rules[3][0] if rules[3] else text


def test_parse_label_against_plain_rules(spark):
    rnd = random.Random(5)
    words = ["0", "1", "10", "Oui", "non", "the", "é1", "oui.", "NON!", "label:", "", "c++", "neutre"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 5))) + rnd.choice(["", ".", "!?", " "]) for _ in range(600)]
    for labels in (["0", "1"], ["oui", "Non", "neutre"], ["c++", "1"]):
        df = spark.createDataFrame([(i, t, labels) for i, t in enumerate(texts)], "i int, t string, l array<string>")
        got = df.select(
            "i",
            match.parse_label(F.col("t"), labels).alias("a"),
            match.parse_label(F.col("t"), F.col("l")).alias("b"),
        ).collect()
        for r in got:
            assert r["a"] == r["b"] == plain_label(texts[r["i"]], labels), texts[r["i"]]


def test_no_labels_keep_the_text(spark):
    df = spark.createDataFrame([(" Free text. ", [])], "t string, l array<string>")
    r = df.select(match.parse_label(F.col("t"), []).alias("a"), match.parse_label(F.col("t"), F.col("l")).alias("b")).first()
    assert (r["a"], r["b"]) == (" Free text. ", " Free text. ")


def test_metrics(spark):
    rows = [(" Chat assistant", ["chat"]), ("le chaton", ["chat"]), ("l'été.", ["été", "x"]), (None, [""]), ("a", [])]
    df = spark.createDataFrame(rows, "answer string, targets array<string>")
    got = [(r["EM"], r["CM"], r["WM"]) for r in evaluate.recompute_metrics(df).collect()]
    assert got[0] == (1, 1, 1) and got[1] == (0, 1, 0) and got[2] == (0, 1, 1)
    assert got[3][:2] == (1, 1) and got[4] == (0, 0, 0)
    assert evaluate.recompute_metrics(df.drop("targets")).columns == ["answer"]
    assert "EM" in evaluate.recompute_metrics(df.withColumnRenamed("answer", "prediction")).columns


def test_three_way_labels(spark):
    df = spark.createDataFrame([("Yes it is",), ("no",), ("not yes",), ("unknown",), ("Nothing",)], "t string")
    assert [r[0] for r in df.select(match.three_way_label(F.col("t"))).collect()] == ["0", "2", "0", "1", "2"]


def test_token_f1(spark):
    rows = [(1, "le chat noir", "le chat"), (2, "a a b", "a c"), (3, "", ""), (4, "x", ""), (5, None, "y"), (6, "Été!", "été")]
    df = spark.createDataFrame(rows, "i int, p string, t string")
    got = {r["i"]: round(r["f1"], 6) for r in evaluate.token_f1(df, "i", "p", "t").collect()}
    assert got == {1: 0.8, 2: 0.4, 3: 1.0, 4: 0.0, 5: 0.0, 6: 1.0}


def test_prompts(spark):
    rows = [("mot", "Q <W> <W>?", "shot", True, True, " ctx "), ("mot", "Q <W>?", "", True, True, " "), ("mot", "Q?", "shot", False, True, None)]
    df = spark.createDataFrame(rows, "w string, p string, o string, k boolean, s boolean, c string")
    got = [r[0] for r in df.select(evaluate.render_prompt(*[F.col(x) for x in "wpoksc"])).collect()]
    assert got == ['Exemple :\nshot\n\n(Contexte : "ctx")\nQ : Q mot mot?\nR :', "Q : Q mot?\nR :", "Q : Q?\nR :"]


def test_grid_size_is_known_up_front(spark):
    items = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("z", 4)], "lf string, i int")
    templates = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "r")], "lf string, pattern string")
    grid = evaluate.prompt_grid(items, templates, "lf")
    assert grid.count() == sum(r["prompts"] for r in evaluate.grid_sizes(items, templates, "lf").collect()) == 20
    assert grid.select("k", "s").distinct().count() == 4


def test_macro_differs_from_micro_and_defaults_to_zero(spark):
    rows = [("m", "t1", 1)] * 3 + [("m", "t2", 0)]
    df = spark.createDataFrame(rows, "model string, task string, ok int")
    assert evaluate.total_micro(df, "model", "ok").first()["micro"] == 0.75
    scores = evaluate.task_scores(df, "model", "task", "ok")
    assert evaluate.total_macro(scores, "model").first()["macro"] == 0.5
    failed = spark.createDataFrame([("x", "t1", None)], "model string, task string, score double")
    assert evaluate.total_macro(failed, "model").first()["macro"] == 0.0


def test_answers_against_target_rows(spark):
    import re

    from lexlake.operators.evaluate import score_answers

    answers = [(1, "k", "red fox"), (2, "k", "fox"), (3, "k", None), (4, "none", "fox"), (5, None, "fox"), (6, "k", "foxes"), (7, "m", "a.b"), (2, "k", "fox"), (8, "k", "")]
    targets = [("k", "fox"), ("k", "owl"), ("k", "fox"), ("k", None), (None, "fox"), ("m", "a.b"), ("m", "")]
    rows = spark.createDataFrame(answers, "id int, a_ string, text string")
    done = score_answers(rows, spark.createDataFrame(targets, "a_ string, target string"), ["a_"], "text")
    assert done.columns == ["id", "a_", "text", "EM", "CM", "WM"]

    def plain(key, answer):
        mine = [t for k, t in targets if k == key and k is not None and t is not None]
        if answer is None or not mine:
            return None, None, None
        return tuple(int(any(test(t) for t in mine)) for test in (lambda t: t == answer, lambda t: t in answer, lambda t: re.search(rf"\b{re.escape(t)}\b", answer)))

    got = sorted((r["id"], r["EM"], r["CM"], r["WM"]) for r in done.collect())
    assert got == sorted((i, *plain(k, x)) for i, k, x in answers)
    plan = done._jdf.queryExecution().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
