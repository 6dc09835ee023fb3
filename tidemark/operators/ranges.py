"""Dealing ranges: the legs between alternating swing extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import SERIES


def runs(points: DataFrame) -> DataFrame:
    """Each swing with its run (swings of one kind in a row, by confirmation) and best, the run's extreme so far (earliest on ties)."""
    order = Window.partitionBy(*SERIES).orderBy("confirmation_index", "i", "kind")
    rows = points.withColumn("_new", F.coalesce((F.lag("kind").over(order) != F.col("kind")).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(order))
    sign = F.when(F.col("kind") == "high", F.col("price")).otherwise(-F.col("price"))
    own = Window.partitionBy(*SERIES, "run").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    point = F.struct("kind", "i", "confirmation_index", "price")
    return rows.withColumn("best", F.max_by(point, F.struct(sign, -F.col("nth"))).over(own)).drop("_new")


def leg_versions(points: DataFrame) -> DataFrame:
    """For every swing that arrives: known_at and, for each direction, the newest leg as struct(start, end), bullish and bearish."""
    rows = runs(points)
    ends = rows.groupBy(*SERIES, "run").agg(F.max_by("best", "nth").alias("final"))
    back = lambda n, name: ends.select(*SERIES, (F.col("run") + n).alias("run"), F.col("final").alias(name))
    rows = rows.join(back(1, "prev"), [*SERIES, "run"], "left").join(back(2, "prev2"), [*SERIES, "run"], "left")
    own = F.when(F.col("prev").isNotNull(), F.struct(F.col("prev").alias("start"), F.col("best").alias("end")))
    old = F.when(F.col("prev2").isNotNull(), F.struct(F.col("prev2").alias("start"), F.col("prev").alias("end")))
    up = F.when(F.col("kind") == "high", own).otherwise(old)
    down = F.when(F.col("kind") == "low", own).otherwise(old)
    return rows.select(*SERIES, "confirmation_index", "nth", "known_at", up.alias("bullish"), down.alias("bearish"), own.alias("latest"))


def range_of(leg: Column, ote_min: float = 0.62, ote_max: float = 0.79) -> Column:
    """The dealing range of a leg: direction, low, high, equilibrium and the optimal entry band; null if it has no height."""
    up = leg["end"]["kind"] == "high"
    low, high = F.when(up, leg["start"]["price"]).otherwise(leg["end"]["price"]), F.when(up, leg["end"]["price"]).otherwise(leg["start"]["price"])
    lower = F.when(up, high - (high - low) * ote_max).otherwise(low + (high - low) * ote_min)
    upper = F.when(up, high - (high - low) * ote_min).otherwise(low + (high - low) * ote_max)
    found = F.struct(F.when(up, "bullish").otherwise("bearish").alias("direction"), leg["start"]["i"].alias("start_index"), leg["end"]["i"].alias("end_index"), F.greatest(leg["start"]["confirmation_index"], leg["end"]["confirmation_index"]).alias("confirmation_index"), low.alias("low"), high.alias("high"), ((low + high) / 2).alias("equilibrium"), lower.alias("ote_lower"), upper.alias("ote_upper"))
    return F.when(leg.isNotNull() & (high > low), found)


def dealing_ranges(points: DataFrame, direction: str | None = None) -> DataFrame:
    """The dealing range of every series at its end: of the newest leg, or of the newest one in a direction."""
    last = leg_versions(points).groupBy(*SERIES).agg(F.max_by(direction or "latest", "nth").alias("leg"))
    return last.select(*SERIES, range_of(F.col("leg")).alias("r")).where("r is not null").select(*SERIES, "r.*")


def anchored_ranges(points: DataFrame, ends: DataFrame) -> DataFrame:
    """The range that ends in the swing of each row of ends (direction, swing_index) and starts at the newest opposite swing before it."""
    want = F.when(F.col("direction") == "bullish", "high").otherwise("low")
    end = points.select(*SERIES, F.col("i").alias("swing_index"), F.struct("kind", "i", "confirmation_index", "price").alias("end"))
    rows = ends.join(end, [*SERIES, "swing_index"]).where(F.col("end.kind") == want)
    order = Window.partitionBy(*SERIES).orderBy("i").rangeBetween(Window.unboundedPreceding, -1)
    before = points.withColumn("h", F.last(F.when(F.col("kind") == "high", F.struct("kind", "i", "confirmation_index", "price")), ignorenulls=True).over(order)).withColumn("l", F.last(F.when(F.col("kind") == "low", F.struct("kind", "i", "confirmation_index", "price")), ignorenulls=True).over(order))
    before = before.select(*SERIES, F.col("i").alias("swing_index"), "kind", "h", "l")
    rows = rows.join(before, [*SERIES, "swing_index"]).where(F.col("kind") == F.col("end.kind"))
    leg = F.struct(F.when(F.col("kind") == "high", F.col("l")).otherwise(F.col("h")).alias("start"), F.col("end"))
    rows = rows.select(*SERIES, "swing_index", range_of(F.when(leg["start"].isNotNull(), leg)).alias("r")).where("r is not null")
    return rows.select(*SERIES, "swing_index", "r.*")


def premium_discount(price: Column, equilibrium: Column) -> Column:
    return F.when(price > equilibrium, "premium").when(price < equilibrium, "discount").when(price == equilibrium, "equilibrium")
