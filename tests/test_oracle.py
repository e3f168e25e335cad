"""Every registered query equals its SQL twin (DuckDB) on the driver tables (sf0.001)."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E

SF = os.environ.get("REPORTLAKE_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    rows = df.collect()
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert isinstance(rows, list)  # approximate operators: rows-only
        return
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(cols) == sorted(dcols)
    order = sorted(cols)
    a = Counter(tuple(_norm(r[c]) for c in order) for r in rows)
    b = Counter(tuple(_norm(r[dcols.index(c)]) for c in order) for r in drows)
    assert a == b


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 48
    assert "representative_power_of_aggr" in df.columns
