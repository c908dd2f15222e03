"""Queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from lumenread.plans import catalogue
from lumenread.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
ORACLE = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    return round(value, 9) + 0.0 if isinstance(value, float) else value


def rows_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(str([plain(r[i]) for i in at]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    frame = catalogue.queries()[name](spark, SF)
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLE)))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 120
