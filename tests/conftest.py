"""A session for all tests, and rows in any order."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    """The smallest test tables."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rows():
    """A frame's rows as a multiset, columns by name; floats to nine digits."""

    def gathered(df) -> Counter:
        columns = sorted(df.columns)
        return Counter(tuple(f"{x:.9g}" if isinstance(x, float) else repr(x) for x in r) for r in df.select(*columns).collect())

    return gathered
