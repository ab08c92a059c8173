"""Every key with an oracle: Spark result == DuckDB result (the driver's check, locally)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as se
from conftest import SF_SMALL

SLOW = {"duration_test", "test_summary"}
KEYS = sorted(k for k in se.oracle_sql())


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["events", "documents", "labels", "benchmark"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = se.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(se.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _canon(df.columns, srows) == _canon(dcols, res.fetchall())


def test_every_oracle_key_is_registered():
    assert set(se.oracle_sql()) <= set(se.queries())


def test_entry_runs(spark):
    assert se.entry(spark).count() > 0
    assert os.path.isdir(SF_SMALL)
