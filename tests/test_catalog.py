"""Every registered query with SQL against DuckDB over the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from corrobix import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    return str(v)[:19] if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    rows = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rows.columns) == columns
    order = [rows.columns.index(c) for c in columns]
    assert got == sorted(([plain(r[i]) for i in order] for r in rows.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0 and "accepted" in rows.columns


def test_every_query_without_sql_runs(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, SF).count() >= 0
