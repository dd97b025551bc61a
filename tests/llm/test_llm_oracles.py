"""Queries of the training-data operators that SQL can say, against DuckDB on the same files."""

import duckdb
import pytest

from gleanery.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    result = connection.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    theirs = sorted(result.fetchall(), key=repr)
    ours = QUERIES[name](spark, SF_DIR)
    assert sorted(ours.columns) == sorted(columns)
    assert sorted((tuple(r) for r in ours.select(*columns).collect()), key=repr) == theirs and theirs


def test_the_entry_lists_queries_and_pipeline():
    import __spark_entry__ as contract

    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())
