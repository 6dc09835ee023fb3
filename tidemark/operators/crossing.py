"""As-of joins and the first bar that crosses a level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import SERIES
from .shared import kept

#: Bars in a block of each tier: a level meets the summaries of large blocks first, then of the small ones in those that
#: can hold its crossing, and bars last. So it meets n / 16384 + 2 * 128 + 2 * 128 rows of a series of n bars.
TIERS = (16384, 128)


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, column: str, keep: list[str], order: list[str] | None = None) -> DataFrame:
    """left with column: a struct of right's columns `keep` in its last row of the same `by` at or before left_time.

    Both sides are dealt once by `by` and met in one running window, so that nothing is paired.
    """
    payload = F.struct(*[F.col(c) for c in keep])
    order = order or []
    r = right.select(*by, F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.struct(*[F.col(c) for c in order], F.lit(0)).alias("_order"), payload.alias("_right"))
    own = left.select(*by, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct(*[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in order], F.lit(0)).alias("_order"), F.struct(*left.columns).alias("_left"))
    both = r.unionByName(own, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_time", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(column, F.last("_right", ignorenulls=True).over(w)).where("_side = 1").select("_left.*", column)


def overlapping(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows of the same `by` (column names of both) whose intervals touch, each pair once; rows with a null bound have none.

    Intervals are dealt by bins as wide as the mean interval of their `by`, so that they lie in 3 bins a row on average
    and rows of distant intervals never meet.
    """
    spans = left.select(*by, (F.col(left_span[1]) - F.col(left_span[0])).alias("_w")).unionByName(right.select(*by, (F.col(right_span[1]) - F.col(right_span[0])).alias("_w")))
    width = spans.groupBy(*by).agg(F.coalesce(F.nullif(F.avg("_w"), F.lit(0.0)), F.lit(1.0)).alias("_width"))
    place = lambda c: F.floor(F.col(c) / F.col("_width"))
    dealt = lambda rows, span, name: rows.join(width, by).withColumn(name, place(span[0])).withColumn("_bin", F.explode(F.sequence(name, place(span[1])))).drop("_width")
    met = dealt(left, left_span, "_l").join(dealt(right, right_span, "_r"), [*by, "_bin"])
    touching = (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1]))
    return met.where((F.col("_bin") == F.greatest("_l", "_r")) & touching).drop("_bin", "_l", "_r")


def first_crossing(levels: DataFrame, bars: DataFrame, key: list[str], start: str, hit: Column, possible: Column, column: str = "crossed", until: str | None = None, sure: bool = True) -> DataFrame:
    """levels with column: the first bar i >= start (and <= until) of its series for which hit holds, or null.

    hit sees the level's columns and the bar's (open, high, low, close); possible is implied by hit for some bar of a
    block, from the block's top_high, low_low, top_close and low_close. If possible implies a hit too (sure), only the
    level's own block and the first later one of each tier are looked into. Below the top tier work is dealt by series
    and block, not by series. levels are read twice, so they are stored once before.
    """
    levels = kept(levels)
    at = lambda tier: F.floor(F.col("i") / tier).cast("int")
    numbered = bars.select(*SERIES, "i", "high", "low", "close", at(TIERS[-1]).alias("_block"))
    columns = levels.columns
    near, above = levels, None
    for tier in TIERS:
        parent = [F.floor(F.min("i") / above).cast("int").alias("_above")] if above else []
        blocks = bars.groupBy(*SERIES, at(tier).alias("_block")).agg(F.max("high").alias("top_high"), F.min("low").alias("low_low"), F.max("close").alias("top_close"), F.min("close").alias("low_close"), *parent)
        own = F.floor(F.col(start) / tier).cast("int")
        ahead = F.col("_block") >= own
        if until:
            ahead = ahead & (F.col("_block") * tier <= F.col(until))
        near = near.withColumnRenamed("_block", "_above").join(blocks, [*SERIES, "_above"] if above else SERIES).where(ahead & possible)
        if sure:
            near = near.groupBy(*columns).agg(F.min(F.when(F.col("_block") == own, F.col("_block"))).alias("_own"), F.min(F.when(F.col("_block") > own, F.col("_block"))).alias("_later"))
            near = near.select(*columns, F.explode(F.array_compact(F.array("_own", "_later"))).alias("_block"))
        near, above = near.select(*columns, "_block"), tier
    fine = near.join(numbered, [*SERIES, "_block"]).where((F.col("i") >= F.col(start)) & hit)
    if until:
        fine = fine.where(F.col("i") <= F.col(until))
    first = fine.groupBy(*SERIES, *key).agg(F.min("i").alias(column))
    return levels.join(first, [*SERIES, *key], "left")
