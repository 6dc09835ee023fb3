"""Bars over Structured Streaming: made from ticks, accepted from feeds, kept in tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upkeep
from ..sources.bars import SERIES, TIMEFRAMES, feed_messages, millis


def stream_bars(ticks: DataFrame, timeframe: str, lateness: str = "10 minutes") -> DataFrame:
    """Closed bars of a tick stream (symbol, ts, seq, price, quantity), each once the watermark has passed its end; later ticks are dropped."""
    length = TIMEFRAMES[timeframe]
    at = F.struct("ts", "seq")
    window = F.window("ts", f"{length // 1000} seconds")
    ticks = ticks.withColumn("ts", F.timestamp_millis(millis(F.col("ts"))))  # as in batch
    bars = ticks.withWatermark("ts", lateness).groupBy("symbol", window.alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"))
    start = F.unix_millis("w.start")
    return bars.select("symbol", F.lit(timeframe).alias("timeframe"), start.alias("open_time_ms"), (start + length - 1).alias("close_time_ms"), "open", "high", "low", "close", "volume")


def stream_messages(lines: DataFrame, symbols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The bars of a feed and, for a dead-letter table, the lines that are invalid."""
    parsed = feed_messages(lines, symbols)
    return parsed.where("outcome = 'ok'").select("bar.*"), parsed.where("outcome = 'invalid'").select("value")


def stream_accepted(bars: DataFrame, arrival: list[str]) -> DataFrame:
    """Bars newer than all that came before in their series, in the order of arrival (columns of bars); a series' state is one number.

    The shuffle keeps no order, so a micro-batch's bars of a series are put in order again; what a trigger may read bounds them.
    Late bars are dropped as the batch form drops them, if arrival does not run back from one batch to the next.
    """

    def newer(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -(2**62)
        own = pd.concat(parts).sort_values(arrival, kind="stable")
        top = own["open_time_ms"].cummax()
        keep = top.shift(fill_value=last).clip(lower=last) < own["open_time_ms"]
        state.update((max(last, int(top.iloc[-1])),))
        yield own[keep]

    return bars.groupBy(*SERIES).applyInPandasWithState(newer, bars.schema, "last bigint", "append", "NoTimeout")


def keep_table(spark: SparkSession, path: str, keep: int = 500, arrival: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges each batch into a bar table and its retention, as a new version that a pointer row names last.

    Of several writes of a bar the last in arrival (columns of the batch, not stored) holds; ties, and all without arrival, go by the values, the
    largest holding. So a batch that is run again makes the same table again; a reader follows the newest complete version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        current = latest(spark, path)
        values = [c for c in batch.columns if c not in upkeep.KEY and c not in (arrival or [])]
        last = F.max(F.struct(*[F.col(c) for c in arrival or []], F.struct(*values).alias("_values")))
        batch = batch.groupBy(*upkeep.KEY).agg(last.alias("_last")).select(*upkeep.KEY, "_last._values.*")
        rows = upkeep.newest(batch, keep) if current is None else upkeep.merged(current, batch, keep)
        version = f"{path}/data/{number}-{uuid.uuid4().hex}"
        rows.write.partitionBy("timeframe").parquet(version)
        spark.createDataFrame([(number, version)], "number bigint, version string").write.mode("append").parquet(f"{path}/versions")

    return merge


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a table that keep_table() wrote."""
    try:
        versions = spark.read.schema("number bigint, version string").parquet(f"{path}/versions")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    row = versions.orderBy(F.desc("number")).first()
    return spark.read.parquet(row["version"]) if row else None


def event_lines(events: DataFrame) -> DataFrame:
    """Events as compact JSON lines, for a message sink."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))
