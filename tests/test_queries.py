"""Every query with SQL agrees with it; the others give rows. TEST_SF_DIR chooses the tables."""

import math
import os

import duckdb
import pytest

from wayfold.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations labels benchmark embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(value):
    """A value that both engines write alike: floats to nine digits."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}" if value else "0"
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return repr(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    ours = catalog.QUERIES[name](spark, SF)
    relation = con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(relation.columns)
    assert sorted(ours.columns) == columns
    theirs = sorted(repr([plain(row[relation.columns.index(c)]) for c in columns]) for row in relation.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in ours.collect()) == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert not catalog.QUERIES[name](spark, SF).isEmpty()
