"""Numbered queries against the SQL that expresses them, over the driver's tables."""

from __future__ import annotations

import duckdb
import pytest

from trackloom.llm import queries

SF = "/root/testdata/sf0.01"


def same(spark, name, sf):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    columns = sorted(want.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r) for r in want.select(*columns).fetchall()), key=key), sorted((tuple(r) for r in got.select(*columns).collect()), key=key)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_queries_equal_their_sql(spark, name):
    want, got = same(spark, name, SF)
    assert want == got and len(got) > 100


def test_every_query_of_the_subpackage_is_numbered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
