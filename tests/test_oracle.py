"""Every query with SQL against DuckDB on the tables that the driver compares; the others must give rows."""

import math
from collections import Counter

import duckdb
import pytest

from quadrille import catalogue

SF = "/root/testdata/sf0.01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "as_integer_ratio"):
        return None if math.isnan(v) else round(float(v), 4)
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), Counter(tuple(plain(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert got[1]
        return
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    expected = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == expected[0]
    assert got[1] == expected[1], (list((got[1] - expected[1]).items())[:3], list((expected[1] - got[1]).items())[:3])
    assert expected[1], "no row to compare"
