"""Every query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from kinframe.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    rows = sorted([tuple(str(r[c]) for c in columns) for r in df.collect()])
    assert rows == sorted(tuple(str(r[i]) for i in place) for r in want.fetchall())


def test_find_table(spark):
    found = {tuple(r)[:2] for r in plans.QUERIES["met2_find_table"](spark, SF).collect()}
    assert found == {("dbo", "supplier"), ("dbo", "orders"), ("dbo", "part")}


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())
