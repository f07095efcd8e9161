"""Every registered query against its DuckDB oracle on the smallest tables."""

import collections

import duckdb
import pytest

from siftwork.plans.registry import ORACLES, QUERIES, load_all
from siftwork.sources.tables import TABLES
from tools.oracle_check import _norm

from .conftest import SF_SMALL

load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    assert name in ORACLES, "every query has an oracle"
    rel = con.sql(ORACLES[name])
    dcols = rel.columns
    assert cols == sorted(dcols)
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    want = collections.Counter(tuple(_norm(r[i]) for i in order) for r in rel.fetchall())
    assert got == want


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
