"""What every family of facts says at any bar, without looking ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alive, liquidity, ranges, structure, zones
from ..operators.crossing import asof
from ..operators.shared import kept
from ..sources.bars import SERIES


def states(bars: DataFrame, at: DataFrame | None = None, width: int = 2) -> DataFrame:
    """One row for each bar asked for (at: symbol, timeframe, i; by default all): what was known at its close.

    swings (confirmed so far), last_break, the newest dealing range, premium_discount, day_levels (of earlier days) and
    of the zones alive then n_bullish, n_bearish, max_bullish (highest upper edge) and min_bearish (lowest lower edge).
    Each family is worked out once over the whole history; bars meet facts on time nodes or in a running window.
    """
    points = kept(structure.swings(bars, width, width))
    events = kept(structure.breaks(bars, points))
    rows = kept((bars if at is None else bars.join(at, [*SERIES, "i"], "left_semi")).select(*SERIES, "i", "close", "close_time_ms"))
    sizes = alive.heights(bars)
    found = alive.on_bars(zones.zones(bars, zones.order_blocks(bars, events), zones.gaps(bars)), bars, SERIES)
    up, down = F.col("direction") == "bullish", F.col("direction") == "bearish"
    live = alive.counts(rows, found, SERIES, sizes, F.count(F.when(up, 1)).alias("n_bullish"), F.count(F.when(down, 1)).alias("n_bearish"), F.max(F.when(up, F.col("upper"))).alias("max_bullish"), F.min(F.when(down, F.col("lower"))).alias("min_bearish"))
    days = liquidity.previous_days(bars).select(*SERIES, (F.col("confirmation_index") + 1).alias("from_i"), F.lit(None).cast("int").alias("until_i"))
    for name, facts in (("swings", points.select(*SERIES, F.col("confirmation_index").alias("from_i"), F.lit(None).cast("int").alias("until_i"))), ("day_levels", days)):
        rows = rows.join(alive.counts(rows, facts, SERIES, sizes, F.count(F.lit(1)).alias(name)), [*SERIES, "i"], "left").fillna(0, [name])
    rows = rows.join(live, [*SERIES, "i"], "left").fillna(0, ["n_bullish", "n_bearish"])
    rows = asof(rows, events.withColumnRenamed("level", "broken"), SERIES, "i", "candle_index", "last_break", ["kind", "direction", "broken"])
    rows = asof(rows, ranges.leg_versions(points), SERIES, "i", "confirmation_index", "_leg", ["latest"], ["nth"])
    rows = rows.withColumn("dealing_range", ranges.range_of(F.col("_leg.latest"))).drop("_leg")
    return rows.withColumn("premium_discount", ranges.premium_discount(F.col("close"), F.col("dealing_range.equilibrium")))
