"""Every registered query against its SQL check on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as registered

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(int(v) if v == int(v) else v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return "=" + v if isinstance(v, str) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query_matches_its_check(spark, duck, name):
    df = registered.queries()[name](spark, DATA)
    columns, rows = table(df.columns, [tuple(r) for r in df.collect()])
    assert rows
    sql = registered.oracle_sql().get(name)
    if sql:
        cursor = duck.execute(sql)
        assert (columns, rows) == table([c[0] for c in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert registered.entry(spark).columns[0] == "numero_guia"


def test_checks_belong_to_queries():
    assert set(registered.oracle_sql()) <= set(registered.queries())
