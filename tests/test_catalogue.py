"""Every query against its SQL on the smallest tables."""

import decimal

import duckdb
import pytest

from loomgraph.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return round(float(value), 6)
    return value.isoformat()[:19] if hasattr(value, "isoformat") else value


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, sf, duck, name):
    frame = catalogue.QUERIES[name](spark, sf)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = [tuple(plain(v) for v in row) for row in found.fetchall()]
    got = [tuple(plain(row[c]) for c in columns) for row in frame.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
