"""Registered queries against their SQL on the small driver tables.

A quick selection by default; DRIFTLINE_ALL=1 runs every query that has SQL.
"""

import importlib.util
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from driftline.catalog import load

FOLDER = Path("/root/testdata/sf0.001")
QUICK = ["dq_key_report", "stratum_stats", "trend_table", "rolling10", "cusum", "stump_threshold",
         "entry_rate_baseline", "spearman_pairs", "alerts_all", "time_split", "pairing_resolved"]

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables not present")

spec = importlib.util.spec_from_file_location("check", Path(__file__).resolve().parent.parent / "tools/check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in check.TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    own = load()
    assert set(own.queries) == set(own.oracle)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(load().oracle) if os.environ.get("DRIFTLINE_ALL") else QUICK)
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, str(FOLDER)).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.rows(got) == check.rows(want)
