"""Streams give what batches give."""

from pyspark.sql import functions as F

from tidemark.operators import upkeep
from tidemark.sources import bars as source
from tidemark.streaming import bars as streaming

FOLDER = "/root/testdata/sf0.001"


def run(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()


def ticks(spark, folder):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("quantity"))
    events.orderBy("ts").coalesce(1).write.parquet(folder)
    return spark.readStream.schema(events.schema).parquet(folder)


def test_bars_from_a_stream(spark, tmp_path):
    run(streaming.stream_bars(ticks(spark, str(tmp_path / "ticks")), "1h", "0 seconds"), "streamed_bars")
    batch = source.bars_of(source.event_ticks(spark.read.parquet(f"{FOLDER}/events.parquet")), ["1h"])
    mine = spark.table("streamed_bars")
    assert mine.count() > 0 and mine.exceptAll(batch.select(*mine.columns)).count() == 0


def test_accepted_and_kept(spark, tmp_path):
    bars = source.bars_of(source.event_ticks(spark.read.parquet(f"{FOLDER}/events.parquet")), ["4h"])
    bars.where("symbol <> 'view'").coalesce(1).write.parquet(str(tmp_path / "bars"))
    stream = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "bars"))
    run(streaming.stream_accepted(stream, ["open_time_ms"]), "accepted_bars")
    assert spark.table("accepted_bars").count() == bars.where("symbol <> 'view'").count()
    query = stream.writeStream.foreachBatch(streaming.keep_table(spark, str(tmp_path / "table"), 20)).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    kept = streaming.latest(spark, str(tmp_path / "table"))
    assert sorted(kept.select("symbol", "open_time_ms").collect()) == sorted(upkeep.newest(bars.where("symbol <> 'view'"), 20).select("symbol", "open_time_ms").collect())


def test_late_bars_are_dropped_as_in_a_batch(spark, tmp_path):
    rows = [("A", "1m", n, at * 60_000, float(n)) for n, at in enumerate([3, 1, 4, 4, 2, 7, 6, 9])] + [("B", "1m", n, at * 60_000, float(n)) for n, at in enumerate([5, 4, 6])]
    bars = spark.createDataFrame(rows, "symbol string, timeframe string, arrival int, open_time_ms bigint, close double")
    bars.orderBy("open_time_ms").write.parquet(str(tmp_path / "bars"))
    stream = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "bars"))
    run(streaming.stream_accepted(stream, ["arrival"]), "late_bars")
    mine = sorted((r["symbol"], r["arrival"]) for r in spark.table("late_bars").collect())
    assert mine == [("A", 0), ("A", 2), ("A", 5), ("A", 7), ("B", 0), ("B", 2)]
    assert mine == sorted((r["symbol"], r["arrival"]) for r in upkeep.accepted(bars, ["arrival"]).collect())


def test_last_write_holds(spark, tmp_path):
    rows = [("A", "1m", 0, 0, 9.0), ("A", "1m", 1, 0, 2.0), ("A", "1m", 2, 60_000, 3.0)]
    batch = spark.createDataFrame(rows, "symbol string, timeframe string, arrival int, open_time_ms bigint, close double").repartition(3)
    streaming.keep_table(spark, str(tmp_path / "t"), arrival=["arrival"])(batch, 0)
    assert sorted(r["close"] for r in streaming.latest(spark, str(tmp_path / "t")).collect()) == [2.0, 3.0]
