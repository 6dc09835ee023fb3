"""Events without a type are series of their own, as in the SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("nulls")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumn("event_type", F.when(F.col("event_id") % 7 > 0, F.col("event_type"))).coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["a4_history_load", "a5_upsert_retention", "a6_window_read", "a9_gap_recovery", "b_chunked_windows"])
def test_bars_without_a_symbol_are_kept(spark, folder, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    want = db.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in queries()[name](spark, str(folder)).select(columns).collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str)
    assert any(r[0] is None for r in got)
