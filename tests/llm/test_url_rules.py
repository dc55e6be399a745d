import random

import pytest
from helpers import clashing
from pyspark.sql import functions as F

from lexlake.llm import url_rules as u
from lexlake.llm.queries import URL_RULES

SCHEMA = "host string, path string, verdict string"


def brute(url, rules, default="allow"):
    """(host, path, rule, verdict) by trying every rule."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [
        (len(h.split(".")) if h else 0, len(p), v, h + p)
        for h, p, v in rules
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[3], best[2]


URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://Example.COM/en/1", "http://example.com", "http://example.com/en", "http://example.com/en/",
    "https://a.b.example.com/en/x?y=/fr/", "https://www.example.com/en/x#/z", "https://xwww.example.com/en/x", "https://notexample.com/en/x",
    "ftp://x.net/es/", "ftp://x.net/es", "ftp://net/fr/1", "ftp://a.org/es/1", "x://y://z.com/en/", "http://example.com:80/en/", "http://com/",
    "http://..com/", "http://éxample.com/en/ü", "http://a.net?q=://b.com/en/", "http://www.example.com./en/", "http://a\nb.com/en\n/",
    "http://" + "a." * 3000 + "com/" + "en/" * 3000,
]


@pytest.mark.parametrize("entries", [200_000, 0])
def test_rules_of_the_query_by_trie_and_by_key(spark, entries):
    pages = spark.createDataFrame([(i, url) for i, url in enumerate([*URLS, *URLS[:9]])], "page_id long, url string")
    done = u.filter_urls(pages, spark.createDataFrame(URL_RULES, SCHEMA), entries=entries)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in done.collect()}
    assert got == {r["page_id"]: brute(r["url"], URL_RULES) for r in pages.collect()}


@pytest.mark.parametrize("entries", [200_000, 0])
def test_random_rules_against_brute_force(spark, entries):
    rng = random.Random(7)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    path = lambda: rng.choice(["", "/", "/x", "/x/", "/xy/z", "/x/y", "/x/y/"])
    rules = [(rng.choice([host(), host(), ""]), path(), rng.choice(["allow", "block"])) for _ in range(60)]
    pages = [(i, f"http://{host()}{path()}{rng.choice(['', 'y', '/y', '/y/z'])}") for i in range(800)]
    done = u.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, SCHEMA), default="block", entries=entries)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in done.collect()} == {i: brute(x, rules, "block") for i, x in pages}


def test_odd_rows_and_names(spark):
    pages = spark.createDataFrame([(1, "http://x.com/"), (1, "http://x.com/"), (None, None)], "page_id long, url string")
    pages = clashing(pages).withColumn("path", F.lit("own")).withColumn("rule", F.array(F.lit(1))).withColumn("verdict", F.lit(None).cast("int"))
    rules = spark.createDataFrame([("COM", None, "block"), (None, "/q", "allow"), ("com", "", None), ("com", "", "perhaps")], SCHEMA)
    done = u.filter_urls(pages, rules)
    assert done.columns == [*pages.columns, "host_", "path_", "rule_", "verdict_"]
    rows = done.select("host", "path", "host_", "path_", "rule_", "verdict_").collect()
    assert [tuple(r) for r in rows] == [("taken", "own", "x.com", "/", "com", "block")] * 2 + [("taken", "own", "", "", None, "allow")]
    assert u.filter_urls(pages.limit(0), rules).count() == 0
    assert u.filter_urls(pages, rules.limit(0)).where("verdict_ = 'allow' AND rule_ IS NULL").count() == 3
