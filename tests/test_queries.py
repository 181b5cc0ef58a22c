"""Every registered query runs on the smallest tables; its SQL gives the same rows."""

import math

import duckdb
import pytest

from tracewright.plans import registry

QUERIES, SQL = registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small_dir}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small_dir, con, name):
    df = QUERIES[name](spark, small_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        rel = con.sql(SQL[name])
        assert got == rows(rel.columns, rel.fetchall())


def test_names():
    assert set(SQL) <= set(QUERIES)
