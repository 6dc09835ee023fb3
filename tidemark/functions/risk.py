"""Risk, entry limits, costs and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINIMUM_RR = 1.49
#: Cost of a side as a share of the price.
RATE = 0.0005
#: Wider stops for leveraged instruments (fixed values).
STOP_BUFFERS = {"SOXLUSDT": 0.5, "SOXSUSDT": 0.5, "KORUUSDT": 0.5, "SNXXUSDT": 0.5}


def side(direction: Column) -> Column:
    return F.when(direction == "long", 1).when(direction == "short", -1)


def risk_reward(direction: Column, entry: Column, stop: Column, target: Column) -> Column:
    """Reward over risk; null unless the entry lies strictly between stop and target on the direction's side."""
    sign = side(direction)
    return F.when((sign * (entry - stop) > 0) & (sign * (target - entry) > 0), F.abs(target - entry) / F.abs(entry - stop))


def entry_limit(direction: Column, target: Column, stop: Column, tick: Column, least: float = 1.5) -> Column:
    """The worst price that still has the least reward, on the tick, floored for longs and raised for shorts; null unless strictly between stop and target.

    Decimals with small precision keep their scale: a whole number of ticks as decimal(17,0) times the tick is exact.
    """
    exact = lambda c: c.cast("decimal(20,10)")
    raw = (exact(target) + exact(F.lit(str(least))) * exact(stop)) / exact(F.lit(str(1 + least)))
    ticks = F.when(direction == "long", F.floor(raw / exact(tick))).otherwise(F.ceil(raw / exact(tick)))
    limit = (ticks.cast("decimal(17,0)") * exact(tick)).cast("double")
    low, high = F.least(stop, target), F.greatest(stop, target)
    return F.when((tick > 0) & (limit > low) & (limit < high), limit)


def stop_buffer(symbol: Column, profile_buffer: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in STOP_BUFFERS.items() for x in kv])
    return F.greatest(profile_buffer, F.coalesce(named[symbol], profile_buffer))


def atr_stop(direction: Column, base: Column, buffer: Column, reach: Column) -> Column:
    return base - side(direction) * buffer * reach


def commission(entry: Column, leave: Column, stop: Column, rate: float = RATE) -> Column:
    """Cost of both sides in units of risk."""
    return F.lit(min(max(rate, 0.0), 0.01)) * (entry + leave) / F.abs(entry - stop)


def minimum_stop(reach: Column, entry: Column, rate: float = RATE) -> Column:
    return F.greatest(reach * 0.5, entry * (4 * rate))


def score(evidence: str) -> Column:
    """Named points of an evidence struct: array of (name, points); the total is their sum, ten at most."""
    flag = lambda name, points: F.struct(F.lit(name).alias("name"), F.when(F.col(f"{evidence}.{name}"), points).otherwise(0).alias("points"))
    average, volume = F.col(f"{evidence}.average_volume"), F.col(f"{evidence}.confirmation_volume")
    bonus = F.struct(F.lit("volume_above_1_5x_average").alias("name"), F.when((average > 0) & (volume > 1.5 * average), 1).otherwise(0).alias("points"))
    return F.array(flag("liquidity_sweep", 2), flag("order_block_fvg_overlap", 2), flag("ote_overlap", 1), flag("higher_timeframe_bias_aligned", 2), flag("higher_timeframe_agreement", 1), bonus, flag("clean_path_to_tp1", 1))


def total(points: Column) -> Column:
    return F.aggregate(points, F.lit(0), lambda a, x: a + x["points"])
