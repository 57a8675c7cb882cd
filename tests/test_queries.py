"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_DIR
from tokenmill.plans.queries import registered

# those of the optional subpackage have tests of their own
QUERIES, SQL = registered(), entry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, database, name):
    ours = QUERIES[name](spark, SF_DIR).toArrow()
    theirs = database.sql(SQL[name]).to_arrow_table()
    assert {f.name: str(f.type) for f in ours.schema} == {f.name: str(f.type) for f in theirs.schema}
    assert ours.num_rows > 0
    pd.testing.assert_frame_equal(ordered(ours.to_pandas()), ordered(theirs.to_pandas()))


def test_no_join_without_a_key(spark):
    for name in ("split_exact", "global_index", "shuffle_batches", "rtd_labels", "epoch_metrics", "concat_segments"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["file_key", "example_id"]
