"""Every query with SQL for it, against DuckDB on the same files."""

import datetime
import decimal
import os

import duckdb
import pytest

from gleanery.queries import all_oracles, all_queries

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()
# The standard limits are out of reach of the smallest conversation table.
NONE_AT_SMALLEST = {"request_budget"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 6))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(comparable(r[i]) for i in order) for r in rows), key=repr)


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_matches_sql(spark, duck, name):
    ours = all_queries()[name](spark, SF_DIR)
    result = duck.execute(all_oracles()[name])
    columns = [c[0] for c in result.description]
    theirs = result.fetchall()
    assert sorted(ours.columns) == sorted(columns)
    assert table_of(ours.columns, ours.collect()) == table_of(columns, theirs)
    assert theirs or name in NONE_AT_SMALLEST, "the check must compare something"


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_query_without_sql_runs(spark, name):
    assert all_queries()[name](spark, SF_DIR).count() > 0


def test_flagship(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 32
    assert set(all_queries()) <= set(contract.queries())
