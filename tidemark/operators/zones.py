"""Order blocks and fair value gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import SERIES
from .chunks import inside, own, so_far, with_halo
from .crossing import first_crossing


def bull() -> Column:
    return F.col("direction") == "bullish"


def order_blocks(bars: DataFrame, events: DataFrame) -> DataFrame:
    """direction, candle_index, confirmation_index, lower, upper, source_kind, source_swing_index and known_at of order blocks.

    The body of the last candle against the break's direction strictly between broken swing and break; one block a
    candle and direction, that of the first break.
    """
    body = F.struct("i", F.least("open", "close").alias("lower"), F.greatest("open", "close").alias("upper"))
    colours = {"down": ("last", F.when(F.col("close") < F.col("open"), body)), "up": ("last", F.when(F.col("close") > F.col("open"), body))}
    seen = so_far(bars.select(*SERIES, "i", "open", "close"), colours).select(*SERIES, F.col("i").alias("candle_index"), "down", "up")
    found = events.join(seen, [*SERIES, "candle_index"]).withColumn("b", F.when(bull(), F.col("down")).otherwise(F.col("up")))
    found = found.where(F.col("b.i") >= F.col("swing_index") + 1)
    first = F.row_number().over(Window.partitionBy(*SERIES, "direction", "b.i").orderBy("candle_index"))
    found = found.withColumn("_n", first).where("_n = 1")
    return found.select(*SERIES, "direction", F.col("b.i").alias("candle_index"), F.col("candle_index").alias("confirmation_index"), "b.lower", "b.upper", F.col("kind").alias("source_kind"), F.col("swing_index").alias("source_swing_index"), "known_at")


def mitigated_by(close: Column) -> Column:
    """Whether a close goes through a block."""
    return F.when(bull(), close < F.col("lower")).otherwise(close > F.col("upper"))


def mitigation(bars: DataFrame, blocks: DataFrame, as_of: str | None = None) -> DataFrame:
    """blocks with mitigation_index, the first close through the block after its confirmation (up to the bar in column as_of), and dead_at, its time."""
    named = blocks.withColumn("_next", F.col("confirmation_index") + 1)
    possible = F.when(bull(), F.col("low_close") < F.col("lower")).otherwise(F.col("top_close") > F.col("upper"))
    found = first_crossing(named, bars, ["direction", "candle_index"], "_next", mitigated_by(F.col("close")), possible, "mitigation_index", until=as_of).drop("_next")
    return with_time(found, bars, "mitigation_index", "dead_at")


def with_time(rows: DataFrame, bars: DataFrame, index: str, name: str) -> DataFrame:
    times = bars.select(*SERIES, F.col("i").alias(index), F.col("close_time_ms").alias(name))
    return rows.join(times, [*SERIES, index], "left")


def gaps(bars: DataFrame) -> DataFrame:
    """direction, first_candle_index, confirmation_index, lower, upper and known_at of fair value gaps; touching bars leave none."""
    near = with_halo(bars.select(*SERIES, "i", "high", "low", F.col("close_time_ms").alias("known_at")), before=2)
    seen = own(near.select("*", F.lag("high", 2).over(inside()).alias("h"), F.lag("low", 2).over(inside()).alias("l")))
    up = F.when(F.col("low") > F.col("h"), F.struct(F.lit("bullish").alias("direction"), F.col("h").alias("lower"), F.col("low").alias("upper")))
    down = F.when(F.col("high") < F.col("l"), F.struct(F.lit("bearish").alias("direction"), F.col("high").alias("lower"), F.col("l").alias("upper")))
    return seen.withColumn("g", F.coalesce(up, down)).where("g is not null").select(*SERIES, "g.direction", (F.col("i") - 2).alias("first_candle_index"), F.col("i").alias("confirmation_index"), "g.lower", "g.upper", "known_at")


def fills(bars: DataFrame, found: DataFrame) -> DataFrame:
    """gaps with fill_percent and fully_filled at the series' end, and fill_index and dead_at of the bar that filled them."""
    deepest = so_far(bars.select(*SERIES, "i", "high", "low"), {"_low": ("min", F.col("low")), "_high": ("max", F.col("high"))}, ahead=True)
    deepest = deepest.select(*SERIES, F.col("i").alias("confirmation_index"), "_low", "_high")
    rows = found.join(deepest, [*SERIES, "confirmation_index"])
    width = F.col("upper") - F.col("lower")
    depth = F.when(bull(), F.col("upper") - F.coalesce("_low", "upper")).otherwise(F.coalesce("_high", "lower") - F.col("lower"))
    depth = F.least(width, F.greatest(F.lit(0.0), depth))
    rows = rows.withColumn("fully_filled", depth >= width).withColumn("fill_percent", F.when(depth >= width, 100.0).otherwise(F.least(F.round(depth / width * 100, 8), F.lit(99.99999999)))).drop("_low", "_high")
    named = rows.withColumn("_next", F.col("confirmation_index") + 1)
    hit = F.when(bull(), F.col("upper") - F.col("low") >= width).otherwise(F.col("high") - F.col("lower") >= width)
    possible = F.when(bull(), F.col("upper") - F.col("low_low") >= width).otherwise(F.col("top_high") - F.col("lower") >= width)
    return with_time(first_crossing(named, bars, ["confirmation_index"], "_next", hit, possible, "fill_index").drop("_next"), bars, "fill_index", "dead_at")


def zones(bars: DataFrame, blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Both kinds as validity intervals: zone_kind, direction, lower, upper, formed (bar), rank (order of listing), known_at, dead_at (null: never)."""
    a = mitigation(bars, blocks).select(*SERIES, F.lit("OB").alias("zone_kind"), "direction", "lower", "upper", F.col("candle_index").alias("formed"), F.struct(F.lit(0), "confirmation_index").alias("rank"), "known_at", "dead_at")
    b = fills(bars, found).select(*SERIES, F.lit("FVG").alias("zone_kind"), "direction", "lower", "upper", F.col("confirmation_index").alias("formed"), F.struct(F.lit(0) + 1, "confirmation_index").alias("rank"), "known_at", "dead_at")
    rows = a.unionByName(b)
    return rows.join(bars.select(*SERIES, F.col("i").alias("formed"), F.col("open_time_ms").alias("zone_open_ms"), F.col("close_time_ms").alias("zone_close_ms")), [*SERIES, "formed"])
