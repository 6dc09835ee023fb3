"""Swings and structure breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import SERIES
from .chunks import inside, numbered, own, with_halo
from .crossing import first_crossing


def indexed(bars: DataFrame) -> DataFrame:
    """bars with i, their number in the series from 0."""
    return numbered(bars)


def swings(bars: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """kind, i, confirmation_index, price and known_at (close of the confirming bar) of swing highs and lows.

    A high tops all of the bars before it in its window and none after it tops it: of a plateau the earliest. Only
    bars with full windows count.
    """
    before, after = inside().rowsBetween(-left, -1), inside().rowsBetween(1, right)
    near = with_halo(bars.select(*SERIES, "i", "high", "low", "close_time_ms"), left, right)
    seen = near.select(*SERIES, "_chunk", "_own", "i", "high", "low", F.max("high").over(before).alias("hb"), F.min("low").over(before).alias("lb"), F.max("high").over(after).alias("ha"), F.min("low").over(after).alias("la"), F.count("high").over(after).alias("n"), F.lead("close_time_ms", right).over(inside()).alias("known_at"))
    seen = own(seen).where((F.col("i") >= left) & (F.col("n") == right))
    high = F.when((F.col("high") > F.col("hb")) & (F.col("high") >= F.col("ha")), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price")))
    low = F.when((F.col("low") < F.col("lb")) & (F.col("low") <= F.col("la")), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price")))
    found = seen.select(*SERIES, "i", "known_at", F.explode(F.array_compact(F.array(high, low))).alias("s"))
    return found.select(*SERIES, "s.kind", "i", (F.col("i") + right).alias("confirmation_index"), "s.price", "known_at")


def breaks(bars: DataFrame, points: DataFrame) -> DataFrame:
    """kind (BOS or CHoCH), direction, candle_index, swing_index, level and known_at of structure breaks.

    A swing can be broken from its confirmation on, by a close beyond it; if the close before was beyond already it
    never is. Each swing's crossing is its own; of those crossed on one bar the newest gives the event; an event
    against the direction of the one before changes the character (CHoCH), others continue (BOS).
    """
    closes = bars.select(*SERIES, (F.col("i") + 1).alias("confirmation_index"), F.col("close").alias("_before"))
    level = points.join(closes, [*SERIES, "confirmation_index"], "left")
    beyond = F.when(F.col("kind") == "high", F.col("_before") > F.col("price")).otherwise(F.col("_before") < F.col("price"))
    level = level.where(~F.coalesce(beyond, F.lit(False))).select(*SERIES, "kind", "confirmation_index", F.col("i").alias("swing_index"), "price")
    hit = F.when(F.col("kind") == "high", F.col("close") > F.col("price")).otherwise(F.col("close") < F.col("price"))
    possible = F.when(F.col("kind") == "high", F.col("top_close") > F.col("price")).otherwise(F.col("low_close") < F.col("price"))
    crossed = first_crossing(level, bars, ["kind", "swing_index"], "confirmation_index", hit, possible, "candle_index").where("candle_index is not null")
    newest = crossed.groupBy(*SERIES, "candle_index").agg(F.max_by(F.struct("kind", "swing_index", "price"), F.struct("confirmation_index", "swing_index")).alias("s"))
    events = newest.select(*SERIES, "candle_index", F.when(F.col("s.kind") == "high", "bullish").otherwise("bearish").alias("direction"), "s.swing_index", F.col("s.price").alias("level"))
    # events are narrow and far fewer than bars, so one window a series has them
    last = F.lag("direction").over(Window.partitionBy(*SERIES).orderBy("candle_index"))
    events = events.withColumn("kind", F.when(F.coalesce(last != F.col("direction"), F.lit(False)), "CHoCH").otherwise("BOS"))
    times = bars.select(*SERIES, F.col("i").alias("candle_index"), F.col("close_time_ms").alias("known_at"), F.col("open_time_ms").alias("event_open_ms"))
    return events.join(times, [*SERIES, "candle_index"])


def internal_direction(bars: DataFrame, max_age: int = 2, least: int = 5) -> DataFrame:
    """bars with internal_direction: that of the last break of 1-bar swings, no older than max_age bars; null without one or in the first bars."""
    events = breaks(bars, swings(bars, 1, 1)).select(*SERIES, F.col("candle_index").alias("i"), F.col("candle_index").alias("_at"), F.col("direction").alias("_d"))
    # an event is dealt to the bars it reaches, so that no window over bars is needed
    reached = events.withColumn("i", F.explode(F.sequence(F.col("i"), F.col("i") + max_age))).groupBy(*SERIES, "i").agg(F.max_by("_d", "_at").alias("_d"))
    return bars.join(reached, [*SERIES, "i"], "left").withColumn("internal_direction", F.when(F.col("i") >= least - 1, F.col("_d"))).drop("_d")
