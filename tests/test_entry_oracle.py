"""Driver contract: entry() smoke test and a DuckDB oracle check on sf0.001
for every registered query that has one."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from tessera.plans.views import TABLES

def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and df.columns == ["step", "period", "forecast", "lower", "upper"]


def test_registry_shape():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_oracle(spark, sf, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sdf = E.queries()[key](spark, sf)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=str)
    cur = con.execute(E.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    drows = sorted((tuple(_norm(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()), key=str)
    assert srows == drows
