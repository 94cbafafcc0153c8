"""Every query with SQL against the same SQL on an independent engine."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from tidelog.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, (float, Decimal)):
        return f"{float(x):.6f}".rstrip("0").rstrip(".")
    return str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    q = duck.execute(catalog.SQL[name])
    at = [d[0] for d in q.description]
    assert sorted(at) == cols
    assert ours == sorted(tuple(plain(r[at.index(c)]) for c in cols) for r in q.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_without_sql_repeats(spark, name):
    first = sorted(map(str, catalog.QUERIES[name](spark, DATA).collect()))
    assert first and first == sorted(map(str, catalog.QUERIES[name](spark, DATA).collect()))
