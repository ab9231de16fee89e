"""The opN_<name> queries that have SQL against that SQL, on the small tables."""

from pathlib import Path

import duckdb
import pytest

from quernel.llm import oracle, registry
from tests.test_catalogue import DATA, TABLES, rows_of


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    mine = rows_of(df.columns, df.collect())
    assert mine
    if (sql := oracle.SQL.get(name)) is not None:
        other = duck.sql(sql)
        assert sorted(df.columns) == sorted(other.columns)
        assert mine == rows_of(other.columns, other.fetchall())


def test_each_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.queries())
    assert numbers == list(range(1, 14))
