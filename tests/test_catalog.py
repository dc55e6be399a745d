"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as driver  # noqa: E402
from lexlake.catalog import REGISTRY  # noqa: E402
from tools.compare import check, oracle  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SQL = driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, con, name):
    ok, note = check(spark, con, FOLDER, name)
    assert ok, note
    assert " type " not in note, note


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert rows and abs(sum(r["share"] for r in rows) - 1) < 1e-4


def test_every_catalog_query_has_sql():
    assert set(REGISTRY) <= set(SQL)


def test_assembly_derives_its_edges_once(spark):
    done = REGISTRY["assembled_nodes"].run(spark, FOLDER)
    assert not [f for f in done.inputFiles() if "lineitem" in f]
    assert "FullOuter" not in done._jdf.queryExecution().optimizedPlan().toString()
