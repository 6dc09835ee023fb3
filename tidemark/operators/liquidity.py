"""Liquidity pools, day extremes and sweeps."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import SERIES
from .crossing import first_crossing


def day_of() -> Column:
    """The UTC day of a bar."""
    return F.floor(F.col("open_time_ms") / 86_400_000)


def pools(points: DataFrame, bars: DataFrame, tolerance: float = 0.1, max_age: int = 500, members: bool = True) -> DataFrame:
    """Pool versions: pool, version, kind, price, source_indices, confirmation_index, equal_level, superseded_at.

    In order of confirmation a swing joins the most recently made pool of its kind whose last member is near enough
    (tolerance times the average true range at its confirmation) and young enough, or makes one. Each member makes a
    new version, whose price is the mean; a version holds until the next one's confirmation. bars must have atr.
    The order matters, so each series is folded by an Arrow function, over its swings only; pools too old to be
    joined leave the search, which is by price: a swing meets only the pools in its reach. Every version lists all
    its members, so a pool of n swings makes n^2 / 2 indices; without members source_indices is left out.
    """
    at = bars.select(*SERIES, F.col("i").alias("confirmation_index"), "atr")
    rows = points.join(at, [*SERIES, "confirmation_index"]).where("atr > 0").select(*SERIES, "kind", "i", "confirmation_index", "price", "atr")

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["confirmation_index", "i", "kind"])
        found: list[dict] = []
        near: dict[str, list[tuple]] = {}  # by kind, in order of the last price: what can still be joined
        joined: deque[tuple] = deque()
        out: list[tuple] = []
        superseded: list[int | None] = []

        def leave(pool: dict) -> None:
            entries, entry = near[pool["kind"]], (pool["last"], pool["pool"])
            at = bisect_left(entries, entry)
            if at < len(entries) and entries[at] == entry:  # a price that is no number is in no order
                del entries[at]

        for kind, i, conf, price, reach in zip(*[own[c].tolist() for c in ("kind", "i", "confirmation_index", "price", "atr")], strict=True):
            while joined and conf - joined[0][0] > max_age:
                before, number = joined.popleft()
                if found[number]["conf"] == before:
                    leave(found[number])
            entries, most = near.setdefault(kind, []), reach * tolerance
            slack = most + (abs(price) + most) * 1e-12
            span = entries[bisect_left(entries, (price - slack,)) : bisect_right(entries, (price + slack, len(found)))]
            number = max((k for last, k in span if abs(price - last) <= most), default=None)
            if number is None:
                pool = {"pool": len(found), "kind": kind, "members": [], "n": 0, "sum": 0.0}
                found.append(pool)
            else:
                pool = found[number]
                leave(pool)
                superseded[pool["row"]] = conf
            if members:
                pool["members"].append(i)
            pool["n"] += 1
            pool["sum"] += price
            pool |= {"conf": conf, "last": price, "row": len(out)}
            joined.append((conf, pool["pool"]))
            if price == price:
                insort(entries, (price, pool["pool"]))
            n = pool["n"]
            out.append((pool["pool"], n - 1, kind, pool["sum"] / n, list(pool["members"]), conf, n > 1))
            superseded.append(None)
        frame = pd.DataFrame(out, columns=["pool", "version", "kind", "price", "source_indices", "confirmation_index", "equal_level"])
        frame = frame if members else frame.drop(columns="source_indices")
        frame["superseded_at"] = pd.array(superseded, dtype="Int32")
        frame.insert(0, "timeframe", own["timeframe"].iloc[0])
        frame.insert(0, "symbol", own["symbol"].iloc[0])
        return frame

    listed = "source_indices array<int>, " if members else ""
    return rows.groupBy(*SERIES).applyInPandas(fold, f"symbol string, timeframe string, pool int, version int, kind string, price double, {listed}confirmation_index int, equal_level boolean, superseded_at int")


def sweeps(bars: DataFrame, levels: DataFrame, key: list[str], max_age: int = 500) -> DataFrame:
    """levels that were swept, with candle_index and direction: the first bar after confirmation, within max_age, whose wick goes beyond and whose close comes back."""
    named = levels.withColumn("_next", F.col("confirmation_index") + 1).withColumn("_until", F.col("confirmation_index") + max_age)
    top = F.col("kind") == "high"
    hit = F.when(top, (F.col("high") > F.col("price")) & (F.col("close") < F.col("price"))).otherwise((F.col("low") < F.col("price")) & (F.col("close") > F.col("price")))
    possible = F.when(top, (F.col("top_high") > F.col("price")) & (F.col("low_close") < F.col("price"))).otherwise((F.col("low_low") < F.col("price")) & (F.col("top_close") > F.col("price")))
    found = first_crossing(named, bars, key, "_next", hit, possible, "candle_index", until="_until", sure=False).drop("_next", "_until")
    return found.where("candle_index is not null").withColumn("direction", F.when(top, "bearish").otherwise("bullish"))


def previous_days(bars: DataFrame) -> DataFrame:
    """kind, price, source_index, confirmation_index and known_at of each UTC day's extremes, once a later day began; earliest bar on ties."""
    days = bars.withColumn("day", day_of()).groupBy(*SERIES, "day").agg(F.max("high").alias("h"), F.min("low").alias("l"), F.min_by("i", F.struct(-F.col("high"), "i")).alias("hi"), F.min_by("i", F.struct("low", "i")).alias("li"), F.max("i").alias("confirmation_index"))
    order = Window.partitionBy(*SERIES).orderBy("day")
    days = days.withColumn("_later", F.lead("confirmation_index").over(order)).where("_later is not null")
    each = F.explode(F.array(F.struct(F.lit("high").alias("kind"), F.col("h").alias("price"), F.col("hi").alias("source_index")), F.struct(F.lit("low").alias("kind"), F.col("l").alias("price"), F.col("li").alias("source_index"))))
    rows = days.select(*SERIES, "confirmation_index", each.alias("x")).select(*SERIES, "x.*", "confirmation_index")
    times = bars.select(*SERIES, (F.col("i") - 1).alias("confirmation_index"), F.col("close_time_ms").alias("known_at"))
    return rows.join(times, [*SERIES, "confirmation_index"])


def current_day(bars: DataFrame) -> DataFrame:
    """kind, price, source_indices (all ties) and confirmation_index of the extremes of each series' last UTC day, before its last bar."""
    ends = bars.groupBy(*SERIES).agg(F.max("i").alias("_end"), F.max_by(day_of(), "i").alias("_day"))
    day = bars.join(ends, SERIES).where((day_of() == F.col("_day")) & (F.col("i") < F.col("_end")))
    tops = day.groupBy(*SERIES).agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max("i").alias("confirmation_index"))
    ties = day.join(tops, SERIES).groupBy(*SERIES, "h", "l", "confirmation_index").agg(F.sort_array(F.collect_list(F.when(F.col("high") == F.col("h"), F.col("i")))).alias("hs"), F.sort_array(F.collect_list(F.when(F.col("low") == F.col("l"), F.col("i")))).alias("ls"))
    each = F.explode(F.array(F.struct(F.lit("high").alias("kind"), F.col("h").alias("price"), F.col("hs").alias("source_indices")), F.struct(F.lit("low").alias("kind"), F.col("l").alias("price"), F.col("ls").alias("source_indices"))))
    return ties.select(*SERIES, "confirmation_index", each.alias("x")).select(*SERIES, "x.*", "confirmation_index")


def intraday_sweeps(bars: DataFrame) -> DataFrame:
    """direction, candle_index, level, level_kind and known_at of bars that sweep the extreme of the UTC day's earlier bars."""
    own = Window.partitionBy(*SERIES, "day").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    seen = bars.withColumn("day", day_of()).select(*SERIES, "i", "high", "low", "close", "close_time_ms", F.max("high").over(own).alias("h"), F.min("low").over(own).alias("l"))
    high = F.when((F.col("high") > F.col("h")) & (F.col("close") < F.col("h")), F.struct(F.lit("bearish").alias("direction"), F.col("h").alias("level"), F.lit("high").alias("level_kind")))
    low = F.when((F.col("low") < F.col("l")) & (F.col("close") > F.col("l")), F.struct(F.lit("bullish").alias("direction"), F.col("l").alias("level"), F.lit("low").alias("level_kind")))
    return seen.select(*SERIES, F.col("i").alias("candle_index"), F.col("close_time_ms").alias("known_at"), F.explode(F.array_compact(F.array(high, low))).alias("x")).select(*SERIES, "candle_index", "known_at", "x.*")


def near_zone(level: Column, lower: Column, upper: Column, reach: Column, share: float) -> Column:
    """Whether a level lies in a zone or within share times the average true range of it."""
    return F.greatest(lower - level, level - upper, F.lit(0.0)) <= reach * share
