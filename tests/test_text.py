import pytest
from pyspark.sql import functions as F

from lexlake.functions import text


def run(spark, build, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["v"] for r in df.select("i", build(F.col("c")).alias("v")).orderBy("i").collect()]


def test_strip_drops_unicode_blanks(spark):
    values = ["\xa0 a  　", "\t\n", "b\x1f", None]
    assert run(spark, text.strip, values) == ["a", "", "b", None]
    assert run(spark, text.normalize_text, values) == ["a", "", "b", ""]


def test_concat_counts_null_as_empty(spark):
    df = spark.createDataFrame([(None, "mot"), ("se ", "laver"), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(text.concat_nullable(F.col("a"), F.col("b"))).collect()]
    assert got == ["mot", "se laver", ""]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(text.nan_to_null(F.col("x"))).collect()] == [None, 1.5, None]


def test_definition_edits_in_order(spark):
    raw = "Définition  $1  est l' \xa0objet ( de  $2 )  d’ \n une  chose "
    assert run(spark, text.clean_definition, [raw, "La Définition  x"]) == [
        "$1 est l'objet (de $2) d’une chose",
        "La Définition x",
    ]


def test_html_to_text(spark):
    pages = [
        "<p> a <b>b</b>&nbsp;</p><!-- no <p>x</p> --><script>if (a<b) '</p>'</script>c &amp;lt; d",
        '<a title="x > y">link</a><style>p{}</style>&eacute;&#233;&#xE8;&#x1F600;',
        "a < b and 3<4",
        None,
        "",
    ]
    assert run(spark, text.html_to_text, pages) == ["a b c &lt; d", "link ééè😀", "a < b and 3<4", None, ""]


def test_rare_entities_use_the_full_table(spark):
    got = run(spark, lambda c: text.html_to_text(c), ["<i>&alefsym;</i> &amp;", None])
    assert got == ["ℵ &", None]


def test_html_query_leaves_unclosed_references_as_its_sql_does(spark, tmp_path):
    import duckdb

    from lexlake.catalog import REGISTRY

    pages = [(1, "<title>a &amp;&amp</title><p>&copy b &amp; &quot;c&quot;</p>"), (2, "<p>x &ampy</p>"), (3, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    entry = REGISTRY["html_to_text"]
    with duckdb.connect() as con:
        con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
        want = con.execute(entry.sql).fetchall()
    assert sorted(tuple(r) for r in entry.run(spark, str(tmp_path)).select("page_id", "text_md5", "n_text").collect()) == sorted(want)
    assert run(spark, text.html_to_text, [p[1] for p in pages[:2]]) == ["a && © b & \"c\"", "x &y"]


def test_extract_elements(spark):
    xml = [
        "<df><actantpos><tc>$1 <m>est</m>\n un</tc><tc/><tc a='1'>$2 &amp; x</tc></actantpos><tc>no</tc></df>",
        "<df><presup/></df>",
        None,
    ]
    got = run(spark, lambda c: text.extract_elements(c, "actantpos", "tc"), xml)
    assert got == [["$1 est un", "", "$2 & x"], None, None]


@pytest.mark.parametrize(
    "cell,expected",
    [
        ("['A', 'b ']", ["a", "b"]),
        ("""['a', "l'eau"]""", ["a", "l'eau"]),
        (r"['l\'eau', 'x\xa0y']", ["l'eau", "x\xa0y"]),
        ("plain Text", ["plain text"]),
        ("[broken", ["[broken"]),
        ("[]", []),
    ],
)
def test_parse_list(spark, cell, expected):
    assert run(spark, text.parse_list, [cell]) == [expected]


def test_answers(spark):
    assert run(spark, text.clean_answer, [None, " Chat assistant", "assistantassistant", "assistant x"]) == [
        "", "chat", "assistant", "assistant x",
    ]
    assert run(spark, text.first_answer, ["chat, félin", " a\nb", ".x", "mot"]) == ["chat", "a", "", "mot"]


def test_run_names(spark):
    got = run(spark, lambda c: text.clean_run_name(c, "_results"), ["m_base_results_20260410_091638", "m_base_results", "solo", "a_b_c"])
    assert got == ["m_base", "m_base", "solo", "a_b_c"]


def test_percent_text_ties_go_to_even(spark):
    df = spark.createDataFrame([(0.0625,), (0.03125,), (0.00125,), (0.334,), (None,)], "x double")
    one = [r[0] for r in df.select(text.percent_text(F.col("x"), 1)).collect()]
    two = [r[0] for r in df.select(text.percent_text(F.col("x"), 2)).collect()]
    for x, a, b in zip([0.0625, 0.03125, 0.00125, 0.334], one, two):
        assert (a, b) == (f"{x:.1%}", f"{x:.2%}")
    assert one[-1] == "-"


def test_parse_percent(spark):
    assert run(spark, text.parse_percent, ["**33.4%**", "5%", "-", "", "7"]) == [33.4, 5.0, 0.0, 0.0, 7.0]


def slow_kwic(t, occurrence, window=60):
    import re

    spans = [int(x) for x in re.findall(r"\d+", occurrence)]
    if len(spans) < 2:
        return t
    lo, hi = max(0, spans[0] - window), min(len(t), spans[1] + window)
    lo = max([i for i in range(lo + 1) if i == 0 or t[i] in " \n"])
    hi = min([i for i in range(hi, len(t) + 1) if i == len(t) or t[i] in " \n"])
    return ("..." if lo else "") + t[lo:hi].strip() + ("..." if hi < len(t) else "")


def test_kwic_against_a_plain_loop(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for i in range(300):
        n = rnd.randint(1, 400)
        t = "".join(rnd.choice("abé \n") if rnd.random() < 0.4 else "x" for _ in range(n))
        st = rnd.randint(0, n - 1)
        occ = rnd.choice([f"({st};{min(n, st + 5)})", "none", f"{st}"])
        rows.append((i, t, occ))
    df = spark.createDataFrame(rows, "i int, t string, o string")
    got = {r["i"]: r["v"] for r in df.select("i", text.kwic(F.col("t"), F.col("o")).alias("v")).collect()}
    assert got == {i: slow_kwic(t, o) for i, t, o in rows}


def test_numeric_references_never_fail(one):
    from lexlake.functions.text import decode_entities

    cases = {
        "&#9999999;x": "\ufffdx", "&#xD800;": "\ufffd", "&#0;": "\ufffd", "&#146;": "\u2019", "&#x80;": "\u20ac", "&#129;": "\x81",
        "&#99999999999999999999;": "\ufffd", "&#0000065;": "A", "&#x0041;&#65;": "AA", "&#128512;": "\U0001f600", "&#65 b": "A b", "&#;": "&#;",
    }
    for text, want in cases.items():
        assert one({"t": text}, decode_entities(F.col("t")), "t string") == want, text


def test_references_as_the_standard_has_them(spark):
    import html

    texts = [
        "&rarr; &sup2; &eacute x &notit; &notin; &not; &amp;lt; &ampx; &AMP &alefsym; &NotEqualTilde; & &; &# &#x; &#65 &#x41;b &copy&reg;",
        "&acE; a&b=c&gt &gtx &unknown; &eacutes; &frac123; plain", "no reference", "&", "&amp", "&&&amp;&", "",
    ]
    texts += ["".join(f"&{n}" for n in chunk) for chunk in (list(html.entities.html5)[k : k + 40] for k in range(0, 2200, 200))]
    assert run(spark, text.decode_entities, [*texts, None]) == [*[html.unescape(t) for t in texts], None]


class _Reader:
    """Elements by a plain stack, as a lenient parser keeps one."""

    def __new__(cls, markup, parent, tag):
        import re

        tokens = re.findall(rf"""</?(?:{parent}|{tag})(?![\w:.-])(?:[^>"']|"[^"]*"|'[^']*')*>|<[^>]*>|[^<]+""", re.sub(r"(?s)<!--.*?-->", "", markup))
        stack, found = [], []
        for t in tokens:
            name = re.match(r"</?([\w:.-]+)", t)
            name = name and name[1]
            if not t.startswith("<"):
                for e in stack:
                    e[1].append(t)
            elif name not in (parent, tag):
                continue
            elif t.startswith("</"):
                if any(e[0] == name for e in stack):
                    while stack.pop()[0] != name:
                        pass
            else:
                entry = (name, [])
                if name == tag and any(e[0] == parent for e in stack):
                    found.append(entry[1])
                if not t.endswith("/>"):
                    stack.append(entry)
        return [" ".join("".join(x).split()) for x in found] or None


def test_elements_inside_each_other(spark):
    import random

    cases = [
        "<p><t>a<t>b</t>c</t></p><t>out</t>", "<p><p><t>x</t></p><t>y</t></p>", "<p><t>a<t>b</p><t>c</t>", "<p><t/><t k='>'>q</t></t><t>r", "<p/><t>a</t>",
        "<p><tt>no</tt><t>yes</t></p>", "<t><p>z<t>i</t></p></t>", "<p><i>a <t>b <b>c</b></t></i></p>", "</p></t>", "",
    ]
    rng = random.Random(8)
    tokens = ["<p>", "</p>", "<t>", "</t>", "<t/>", "<t a='1'>", "<b>", "</b>", "one ", "two "]
    cases += ["".join(rng.choice(tokens) for _ in range(rng.randrange(30))) for _ in range(200)]
    got = run(spark, lambda c: text.extract_elements(c, "p", "t"), cases)
    assert got == [_Reader(c, "p", "t") for c in cases]


def test_markup_is_cut_once_a_row(spark):
    df = spark.createDataFrame([("<p><t>a</t><!-- <t>b</t> --><t>c &amp; d</t></p>",)], "c string").select(text.extract_elements(F.col("c"), "p", "t").alias("v"))
    assert df.collect()[0]["v"] == ["a", "c & d"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("<!--") == 1
    comment = spark.createDataFrame([("<<!-- x -->p><t>a</t></p>",), ("<t>no parent</t>",)], "c string")
    assert [r[0] for r in comment.select(text.extract_elements(F.col("c"), "p", "t")).collect()] == [["a"], None]
