"""Every query with SQL against an independent engine on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from lexforge.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings corpus_items metadata sentences tokens benchmark sources".split()


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, str):
        return v or ""
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return f"{v:.4f}" if math.isfinite(v) else str(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(name, spark, small, oracle):
    df = catalog.queries()[name](spark, small)
    r = oracle.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = sorted(tuple(plain(x[c]) for c in order) for x in df.collect())
    theirs = sorted(tuple(plain(x[columns.index(c)]) for c in order) for x in r.fetchall())
    assert ours == theirs


def test_queries_without_sql(spark, small):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, small).count() > 0, name
