"""Every graph query with an oracle, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from weftgraph import graph_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(graph_queries.QUERIES))
def test_query(spark, name):
    df = graph_queries.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in graph_queries.ORACLES:
        assert got[1] or name == "metagraph_violations_loops"
        return
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    cur = con.execute(graph_queries.ORACLES[name])
    assert got == rows([c[0] for c in cur.description], cur.fetchall())
