"""Every registered query runs; those with SQL give what the SQL gives."""

import importlib
import os
import sys
from pathlib import Path

import pytest

from energylake.plans.oracle import ORACLE
from energylake.plans.queries import QUERIES

from .oracle_check import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    rows, found = differences(spark, con, SF_DIR, name)
    assert not found
    assert rows > 0 or name == "page_offset"


WINDOWED = {
    "rolling_mean_std": ("rolling_avg", 800),
    "rolling_long_window": ("rolling_std", 90),
    "rolling_with_nulls": ("rolling_avg", 30),
    "lag_features": ("lag_1h", 800),
    "interarrival": ("gap_micros", 900),
}


@pytest.mark.parametrize("name", sorted(WINDOWED))
def test_windows_have_values(spark, name):
    column, least = WINDOWED[name]
    assert QUERIES[name](spark, SF_DIR).dropna(subset=[column]).count() >= least


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_run(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.count() > 0
    assert len(df.columns) == len(set(df.columns))


def test_entry_points(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
