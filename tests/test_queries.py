"""Every query with SQL gives the same rows as DuckDB on the smallest tables; the others give rows."""

import datetime
import decimal

import duckdb
import pytest

from lakeops.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, int | decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.date):
        return v.isoformat()
    return str(v)


def rows(names, records):
    return sorted(([plain(r[c]) for c in sorted(names)] for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in SQL:
        found = duck.sql(SQL[name])
        assert sorted(found.columns) == sorted(df.columns)
        assert got == rows(found.columns, [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()])
