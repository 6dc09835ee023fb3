"""Targets of setups: live liquidity first, then swings beyond it, then the edge of the dealing range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.risk import side
from ..operators import alive, ranges
from ..operators.crossing import asof
from ..operators.shared import kept

#: Targets of a setup, and facts fetched where a limit is compared after rounding: those within it by a rounding error are told apart then.
MOST, SPARE = 3, 9


def past(entry: Column, sign: Column, reach: Column) -> Column:
    """A price short of entry + sign * reach by more than rounding errors, for a search whose hits are compared exactly afterwards."""
    q = entry + sign * reach
    return q - sign * F.greatest(F.abs(q), F.abs(entry), reach) * 4.5e-16


def levels_ahead(rows: DataFrame, levels: DataFrame, sizes: int, edge: Column, k: int = MOST, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """by, i, up and prices: the k nearest distinct prices of levels (by, from_i, until_i, price) alive at i beyond edge in the direction of rows (by, i, direction)."""
    asked = rows.select(*by, "i", (F.col("direction") == "long").alias("up"), edge.alias("edge"))
    found = alive.nearest(asked, levels.select(*by, "from_i", "until_i", "price", F.lit(0).alias("payload")), list(by), sizes, k)
    return found.select(*by, "i", "up", F.col("near.price").alias("prices"))


def tiered(rows: DataFrame, levels: DataFrame, swings: DataFrame, sizes: int) -> DataFrame:
    """symbol, i, direction and targets of rows (symbol, i, direction, entry), nearest first, three at most.

    First the nearest levels (symbol, from_i, until_i, price) ahead, each price once; without one there is no target.
    If fewer than three, swings of the direction's own kind beyond the last target that are confirmed by then, and at
    last the edge of the newest dealing range, if it lies beyond. What comes within 1e-12 of the entry of a target is
    left out; since targets go outwards, only the last one can be so near.
    """
    rows = rows.select("symbol", "i", "direction", "entry", (F.col("direction") == "long").alias("up"))
    sign, near = side(F.col("direction")), F.greatest(F.abs(F.col("entry")) * 1e-12, F.lit(1e-12))
    rows = kept(rows)
    own = kept(rows.join(levels_ahead(rows, levels, sizes, F.col("entry")), ["symbol", "i", "up"]).withColumnRenamed("prices", "targets"))
    kind = F.when(F.col("direction") == "long", "high").otherwise("low")
    facts = swings.select("symbol", "kind", F.col("confirmation_index").alias("from_i"), F.lit(None).cast("int").alias("until_i"), "price")
    last = F.element_at("targets", -1)
    for _ in range(MOST - 1):
        short = own.where(F.size("targets") < MOST).withColumn("kind", kind)
        more = levels_ahead(short, facts, sizes, past(last, sign, near), SPARE, ("symbol", "kind"))
        own = own.join(more.select("symbol", "i", "up", "prices"), ["symbol", "i", "up"], "left")
        next_ = F.filter("prices", lambda p: (F.abs(p - last) > near) & ((p - last) * sign > 0))
        own = kept(own.withColumn("targets", F.concat("targets", F.coalesce(F.slice(next_, 1, 1), F.array().cast("array<double>")))).drop("prices"))
    legs = ranges.leg_versions(swings)
    own = asof(own, legs, ["symbol"], "i", "confirmation_index", "_leg", ["latest"], ["nth"])
    band = ranges.range_of(F.col("_leg.latest"))
    edge = F.when(F.col("direction") == "long", band["high"]).otherwise(band["low"])
    fits = (F.size("targets") < MOST) & ((edge - last) * sign > 0) & (F.abs(edge - last) > near)
    return own.withColumn("targets", F.when(fits, F.array_append("targets", edge)).otherwise(F.col("targets"))).select("symbol", "i", "direction", "targets")
