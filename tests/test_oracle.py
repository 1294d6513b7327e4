"""Every query over the test tables against its SQL in DuckDB."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from shelfspark.demo import queries as demo

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(demo.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    df = demo.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    relation = duck.sql(demo.ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(x[i]) for i in at) for x in relation.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
