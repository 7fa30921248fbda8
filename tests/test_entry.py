"""Driver contract: entry() runs; every oracle-backed query matches DuckDB at sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from panelkit.plans.tables import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "noc" in df.columns


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def test_oracle_queries_match(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    bad = []
    for name, sql in sqls.items():
        df = qs[name](spark, SF)
        cols = sorted(df.columns)
        s_rows = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in df.collect())
        cur = con.execute(sql)
        ocols = [c[0] for c in cur.description]
        idx = [ocols.index(c) for c in cols] if sorted(ocols) == cols else None
        if idx is None:
            bad.append((name, "columns", ocols, df.columns))
            continue
        o_rows = sorted(repr(tuple(_norm(r[i]) for i in idx)) for r in cur.fetchall())
        if s_rows != o_rows:
            bad.append((name, len(s_rows), len(o_rows)))
    assert not bad, bad
