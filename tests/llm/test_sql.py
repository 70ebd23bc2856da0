"""Corpus queries that SQL can express, against DuckDB."""

import pytest

from quadrille.llm import queries
from tests.test_oracle import SF, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SF)
    cur = duck.execute(queries.ORACLE_SQL[name])
    got, expected = rows(df.columns, df.collect()), rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == expected[0] and got[1] == expected[1] and expected[1]
