"""Every catalogue query against its SQL in DuckDB."""

import math
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from quernel.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    mine = rows_of(df.columns, df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert mine
        return
    other = duck.sql(sql)
    assert sorted(df.columns) == sorted(other.columns)
    assert mine == rows_of(other.columns, other.fetchall())


def test_a_broadcast_is_bounded(spark, monkeypatch):
    """A hinted table of more rows than the bound is joined by a shuffle, with the same rows."""
    query = catalogue.queries()["join_broadcast"]
    small = query(spark, DATA)
    monkeypatch.setattr(catalogue, "BROADCAST_ROWS", 100)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # the test's table is small enough for the planner, too
    try:
        large = query(spark, DATA)
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (small, large)]
        assert "BroadcastHashJoin" in plans[0] and "Broadcast" not in plans[1]
        assert rows_of(small.columns, small.collect()) == rows_of(large.columns, large.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
