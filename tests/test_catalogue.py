"""Every query with SQL gives the same rows as the SQL on the smallest tables."""

import glob
import os
from decimal import Decimal

import pytest

from quillgraph.plans import catalogue

D = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, (float, Decimal)):
        return f"{v:.6g}"
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in cur.description]
    rows = cur.fetchall()
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rows)
