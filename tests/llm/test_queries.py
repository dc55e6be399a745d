"""The operators' queries against their SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from lexlake.llm.queries import SQL  # noqa: E402
from tools.compare import check, oracle  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, name):
    ok, note = check(spark, oracle("/root/testdata/sf0.01"), "/root/testdata/sf0.01", name)
    assert ok and " type " not in note, note
