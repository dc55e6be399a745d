import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lexlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests", shuffle_partitions=8, driver_memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of an expression builder on one row: one(values, build)."""

    def value(row: dict, build, schema: str):
        df = spark.createDataFrame([tuple(row.values())], schema)
        return df.select(build.alias("v")).collect()[0]["v"]

    return value
