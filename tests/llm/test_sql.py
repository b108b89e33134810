"""The subpackage's queries against their SQL."""

import duckdb
import pytest

from loomgraph.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, sf)
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in frame.collect()))) == sorted(map(repr, found.fetchall()))


def test_terms_match_sql(spark, tmp_path):
    rows = [(i, f"No {i} says: ask Melchior O'Neil-Roe at mz@corp.org, {'word ' * i}Élan ß+1 (743) 555-3824 Zed") for i in range(6)]
    rows += [(100 + i, f"Plain person {i} says nothing. Ask No one of Zed") for i in range(40)] + [(200, None), (1, rows[1][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    frame = queries.QUERIES["op1_pii"](spark, str(tmp_path))
    found = con.execute(queries.ORACLE_SQL["op1_pii"])
    columns = [d[0] for d in found.description]
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in frame.collect())))
    assert got == sorted(map(repr, found.fetchall())) and any("term:" in x for x in got)
