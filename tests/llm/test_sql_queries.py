"""Queries with SQL agree with it on the smallest tables."""

import duckdb
import pytest

from wayfold.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    ours = QUERIES[name](spark, SF)
    relation = con.sql(ORACLE_SQL[name])
    columns = sorted(relation.columns)
    assert sorted(ours.columns) == columns
    theirs = sorted((repr([row[relation.columns.index(c)] for c in columns]) for row in relation.fetchall()))
    assert sorted(repr([r[c] for c in columns]) for r in ours.collect()) == theirs
