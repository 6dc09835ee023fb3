"""Ticks between two milliseconds, in batch, in streams and in SQL."""

import datetime as dt

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from tidemark.sources import bars as source
from tidemark.streaming.bars import stream_bars

#: The second tick is less than half a millisecond before 00:15, the third and fourth are half or more after 14:59.999.
TIMES = ["00:00:01.000000", "00:14:59.999499", "00:14:59.999500", "00:14:59.999700", "00:15:00.000000", "01:00:00.000400", "09:00:00.000000"]


def events(spark, folder):
    start = dt.datetime(2024, 1, 1)
    rows = [(100 - i, dt.datetime.combine(start, dt.time.fromisoformat(t)), 1, "click", float(i), "{}") for i, t in enumerate(TIMES)]
    made = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    made.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return spark.read.parquet(f"{folder}/events.parquet")


def test_event_times_are_rounded_as_in_the_sql(spark, tmp_path):
    events(spark, tmp_path)
    got = sorted(tuple(r) for r in queries()["k1_bars"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == sorted(db.execute(oracle_sql()["k1_bars"]).fetchall())
    # open, high, low, close, volume: ticks 2 and 3 belong to the second bar, and of equal milliseconds the least event_id opens it
    assert [r[4:] for r in got if r[1] == "15m"][:2] == [(0.0, 1.0, 0.0, 1.0, 2.0), (4.0, 4.0, 2.0, 2.0, 3.0)]


def test_a_stream_rounds_as_history_does(spark, tmp_path):
    made = events(spark, tmp_path)
    made.select(made.event_type.alias("symbol"), made.ts.cast("timestamp").alias("ts"), made.event_id.alias("seq"), made.value.alias("price"), (made.value * 0 + 1).alias("quantity")).coalesce(1).write.parquet(f"{tmp_path}/ticks")
    schema = spark.read.parquet(f"{tmp_path}/ticks").schema
    stream = stream_bars(spark.readStream.schema(schema).parquet(f"{tmp_path}/ticks"), "15m", "0 seconds")
    stream.writeStream.format("memory").queryName("ticks_15m").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    want = source.bars_of(source.event_ticks(made), ["15m"])
    columns = want.columns
    assert sorted(map(tuple, spark.table("ticks_15m").select(columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["a4_history_load", "a5_upsert_retention", "a6_window_read", "a9_gap_recovery", "b_chunked_windows"])
def test_what_is_made_of_bars_rounds_as_its_sql(spark, tmp_path, name):
    events(spark, tmp_path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = db.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in queries()[name](spark, str(tmp_path)).select(columns).collect()]
    assert got and sorted(got, key=str) == sorted(want.fetchall(), key=str)
