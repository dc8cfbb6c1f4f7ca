"""Every query against its SQL twin on the smallest tables."""

import duckdb
import pytest
from pathlib import Path

import __spark_entry__ as entry
from tallymill import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in values)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.queries()) <= set(entry.queries())
    assert set(plans.queries()) - set(entry.oracle_sql()) == {"factorised_ratings"}


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    mine = df.collect()
    if name not in entry.oracle_sql():
        assert mine
        return
    result = sql.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, mine) == rows(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def test_factorisation_beats_the_mean(spark):
    report = entry.queries()["factorised_ratings"](spark, SF).first()
    assert report.ratings > 0 and report.rmse < 20
