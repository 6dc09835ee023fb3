"""What becomes of setups: outcomes, acceptance, state, journal and figures."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.risk import MINIMUM_RR, RATE, commission, side
from ..sources.bars import SERIES
from .crossing import asof, first_crossing
from .shared import kept

LIFE_HOURS = {"scalp": 3, "intraday": 12}
COOLDOWN_MINUTES = {"scalp": 30, "intraday": 120}
LIVE, FINAL = ("ACCEPTED", "ACTIVE", "TP1", "TP2"), ("TP1", "TP2", "TP3", "SL", "EXPIRED")


def by_profile(values: dict[str, int]):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("profile")]


def outcomes(setups: DataFrame, bars: DataFrame, rate: float = RATE) -> DataFrame:
    """setups (symbol, timeframe, confirmation_index and _time_ms, direction, profile, confirmation_price, stop_price, target) with final_status, closed_at_ms, gross_r, commission_r and net_r.

    From the bar after confirmation on the first of stop, target and end of life closes a setup; on one bar the stop
    comes before the target and the target before expiry. Expiry is the first bar that closes at or after the end
    of life, however late it comes. All are null while a setup is open. Three first crossings, no bar-by-bar replay.
    """
    end = F.col("confirmation_time_ms") + by_profile(LIFE_HOURS) * 3_600_000 - 1
    rows = setups.withColumn("_end", end).withColumn("_next", F.col("confirmation_index") + 1)
    rows = asof(rows, bars, SERIES, "_end", "close_time_ms", "_last", ["i"])
    rows = rows.withColumn("_expiry", F.greatest(F.col("_last.i") + 1, F.col("_next"))).drop("_last", "_end")
    long = F.col("direction") == "long"
    stop = F.when(long, F.col("low") <= F.col("stop_price")).otherwise(F.col("high") >= F.col("stop_price"))
    can_stop = F.when(long, F.col("low_low") <= F.col("stop_price")).otherwise(F.col("top_high") >= F.col("stop_price"))
    rows = first_crossing(rows, bars, ["key"], "_next", stop, can_stop, "_sl", until="_expiry")
    target = F.when(long, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    can_target = F.when(long, F.col("top_high") >= F.col("target")).otherwise(F.col("low_low") <= F.col("target"))
    rows = first_crossing(rows, bars, ["key"], "_next", target, can_target, "_tp", until="_expiry")
    first = F.least("_sl", "_tp", "_expiry")
    rows = rows.withColumn("closed_index", first).join(bars.select(*SERIES, F.col("i").alias("closed_index"), F.col("close_time_ms").alias("closed_at_ms"), F.col("close").alias("_close")), [*SERIES, "closed_index"], "left")
    status = F.when(F.col("closed_at_ms").isNull(), None).when(F.col("_sl") == F.col("closed_index"), "SL").when(F.col("_tp") == F.col("closed_index"), "TP1").otherwise("EXPIRED")
    leave = F.when(F.col("final_status") == "SL", F.col("stop_price")).when(F.col("final_status") == "TP1", F.col("target")).otherwise(F.col("_close"))
    gross = F.when(F.col("final_status") == "SL", -1.0).otherwise(side(F.col("direction")) * (leave - F.col("confirmation_price")) / F.abs(F.col("confirmation_price") - F.col("stop_price")))
    rows = rows.withColumn("final_status", status).withColumn("gross_r", F.when(F.col("final_status").isNotNull(), gross)).withColumn("commission_r", F.when(F.col("final_status").isNotNull(), commission(F.col("confirmation_price"), leave, F.col("stop_price"), rate)))
    return rows.withColumn("net_r", F.col("gross_r") - F.col("commission_r")).drop("_next", "_expiry", "_sl", "_tp", "_close", "closed_index")


def partial_exits(setups: DataFrame, bars: DataFrame, weights: tuple[float, ...] = (0.5, 0.3, 0.2)) -> DataFrame:
    """setups (with array targets) with gross_r when each target closes a part and the first one moves the stop to the entry; the rest leaves at the stop.

    Staged crossings: stop and targets, then from the first target on the entry and the targets left.
    """
    long = F.col("direction") == "long"
    rows = setups.withColumn("_next", F.col("confirmation_index") + 1)
    beyond = lambda price, wick, block: (F.when(long, F.col(wick[0]) >= F.col(price)).otherwise(F.col(wick[1]) <= F.col(price)), F.when(long, F.col(block[0]) >= F.col(price)).otherwise(F.col(block[1]) <= F.col(price)))
    under = lambda price: (F.when(long, F.col("low") <= F.col(price)).otherwise(F.col("high") >= F.col(price)), F.when(long, F.col("low_low") <= F.col(price)).otherwise(F.col("top_high") >= F.col(price)))
    for k in range(len(weights)):
        rows = rows.withColumn(f"_t{k}", F.get("targets", F.lit(k)))
        hit, can = beyond(f"_t{k}", ("high", "low"), ("top_high", "low_low"))
        rows = first_crossing(rows, bars, ["key"], "_next", hit, can, f"_i{k}")
    hit, can = under("stop_price")
    rows = first_crossing(rows, bars, ["key"], "_next", hit, can, "_sl")
    started = F.col("_i0").isNotNull() & (F.col("_sl").isNull() | (F.col("_i0") < F.col("_sl")))
    rows = rows.withColumn("_after", F.when(started, F.col("_i0") + 1))
    hit, can = under("confirmation_price")
    rows = first_crossing(rows, bars, ["key"], "_after", hit, can, "_even")
    risk = F.abs(F.col("confirmation_price") - F.col("stop_price"))
    gain = F.lit(0.0)
    for k, weight in enumerate(weights):
        reached = started & F.col(f"_i{k}").isNotNull() & (F.lit(True) if k == 0 else (F.col("_even").isNull() | (F.col(f"_i{k}") < F.col("_even")) | (F.col(f"_i{k}") == F.col("_i0"))))
        gain = gain + F.when(reached, weight * F.abs(F.col(f"_t{k}") - F.col("confirmation_price")) / risk).otherwise(0.0)
    gross = F.when(started, gain).when(F.col("_sl").isNotNull(), -1.0)
    drop = [c for c in rows.columns if c.startswith("_")]
    return rows.withColumn("gross_r", gross).drop(*drop)


def accepted(decided: DataFrame) -> DataFrame:
    """decided (key, symbol, profile, zone_key, confirmation_time_ms, closed_at_ms, risk_reward, status) with accepted, stored, ignored and gate_reasons.

    status is ACCEPTED, CANDIDATE, MISSED_PRICE or REJECTED. Rejected rows are never stored; accepted ones and
    candidates below the least reward are rejected before the gates. In order of time and key the rest are gated: an
    ACCEPTED one if its symbol and profile have an open one (one closed by then is none, the lifecycle coming first),
    an ACCEPTED or CANDIDATE one if its zone has a stored one that began within the cooldown, missed prices apart. A
    MISSED_PRICE meets no gate and starts no cooldown. A key that is stored is ignored from then on, missed prices
    included; one that was rejected, blocked or below the least reward can still be stored by a later row. Every row
    stays in the result; rows of one key and time come in the order of their other columns. A reward of null counts as 0.

    Who comes next depends on who was accepted, so rows are folded in order by an Arrow function; its state is one open
    setup and the zones within the cooldown. A symbol and profile is cut wherever no earlier row can reach on, neither
    open nor by its cooldown, and each piece is a group of its own.
    """
    once = kept(decided.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("confirmation_time_ms", "status", "risk_reward", "zone_key", "closed_at_ms"))))
    below = F.col("status").isin("CANDIDATE", *LIVE) & (F.coalesce("risk_reward", F.lit(0.0)) < MINIMUM_RR)
    narrow = once.where(~below & (F.col("status") != "REJECTED")).select("symbol", "profile", "key", "nth", "zone_key", "status", "confirmation_time_ms", F.coalesce("closed_at_ms", F.lit(2**62)).alias("closes"), (by_profile(COOLDOWN_MINUTES) * 60_000).alias("cooldown"))
    order = Window.partitionBy("symbol", "profile").orderBy("confirmation_time_ms", "key", "nth")
    reach = F.when(F.col("status") == "ACCEPTED", F.greatest("closes", F.col("confirmation_time_ms") + F.col("cooldown") + 1)).when(F.col("status") == "CANDIDATE", F.col("confirmation_time_ms") + F.col("cooldown") + 1)
    # a row reaches to the last row of its key, which it may keep from being stored
    last = F.max("confirmation_time_ms").over(Window.partitionBy("symbol", "profile", "key")) + 1
    reach = F.greatest(reach, F.when(last > F.col("confirmation_time_ms") + 1, last))
    narrow = narrow.withColumn("_reach", reach)
    narrow = narrow.withColumn("_free", F.coalesce(F.max("_reach").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("confirmation_time_ms"), F.lit(False)).cast("int")).drop("_reach")
    narrow = narrow.withColumn("piece", F.sum("_free").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_free")

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["confirmation_time_ms", "key", "nth"])
        closes, zones, out, known = None, {}, [], set()
        for key, nth, zone, status, at, end, cooldown in zip(own["key"], own["nth"], own["zone_key"], own["status"], own["confirmation_time_ms"], own["closes"], own["cooldown"], strict=True):
            if key in known:
                out.append((key, nth, False, None))
                continue
            reasons = []
            if status == "ACCEPTED" and closes is not None and at < closes:
                reasons.append("active_setup_for_symbol_profile")
            if status in ("ACCEPTED", "CANDIDATE") and zone in zones and zones[zone] >= at - cooldown:
                reasons.append("cooldown_active")
            if not reasons and status != "MISSED_PRICE":
                closes = end if status == "ACCEPTED" else closes
                zones = {z: t for z, t in zones.items() if t >= at - cooldown} | {zone: at}
            if not reasons:
                known.add(key)
            out.append((key, nth, not reasons, reasons))
        return pd.DataFrame(out, columns=["key", "nth", "stored", "_gates"])

    gated = narrow.groupBy("symbol", "profile", "piece").applyInPandas(fold, "key string, nth int, stored boolean, _gates array<string>")
    rows = once.join(gated, ["key", "nth"], "left").withColumn("stored", F.coalesce("stored", F.lit(False)))
    none = F.array().cast("array<string>")
    tried = ~below & (F.col("status") != "REJECTED")
    reasons = F.when(below, F.array(F.lit("rr_below_minimum"))).otherwise(F.coalesce("_gates", none))
    rows = rows.withColumn("ignored", tried & F.col("_gates").isNull()).withColumn("gate_reasons", reasons)
    return rows.withColumn("accepted", F.col("stored") & (F.col("status") == "ACCEPTED")).drop("_gates", "nth")


def state_of(events: DataFrame) -> DataFrame:
    """The state that an event log (key, event_time_ms, status) leads to: the newest event, and nothing after one that is not open; with counts of events taken and ignored."""
    order = Window.partitionBy("key").orderBy("event_time_ms", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    done = F.max((~F.col("status").isin("CANDIDATE", *LIVE)).cast("int")).over(before)
    rows = events.withColumn("_ignored", F.coalesce(done == 1, F.lit(False)) | F.coalesce((F.lag("status").over(order) == F.col("status")) & (F.lag("event_time_ms").over(order) >= F.col("event_time_ms")), F.lit(False)))
    own = F.when(~F.col("_ignored"), F.struct("event_time_ms", "seq"))
    return rows.groupBy("key").agg(F.max_by("status", own).alias("status"), F.max(F.when(~F.col("_ignored"), F.col("event_time_ms"))).alias("last_event_time_ms"), F.count(F.when(~F.col("_ignored"), 1)).alias("events"), F.count(F.when(F.col("_ignored"), 1)).alias("ignored"))


def journal(setups: DataFrame, events: DataFrame) -> DataFrame:
    """Closed setups that were accepted once, newest first."""
    rows = setups.where(F.col("final_status").isin(*FINAL) & F.lower("profile").isin(*LIFE_HOURS))
    return rows.join(events.where("status = 'ACCEPTED'").select("key"), "key", "left_semi").orderBy(F.desc("closed_at_ms"), "key")


def quarantined(rows: DataFrame, least: float = MINIMUM_RR) -> DataFrame:
    """rows (status, risk_reward) with open ones below the least reward rejected, and why."""
    low = F.col("status").isin("CANDIDATE", *LIVE) & (F.coalesce("risk_reward", F.lit(0.0)) < least)
    return rows.withColumn("reason", F.when(low, "rr_below_minimum")).withColumn("status", F.when(low, "REJECTED").otherwise(F.col("status")))


def anomaly(limit: float = 5.0, results: tuple[str, ...] = ("net_r", "gross_r")):
    """Whether a journal row cannot be right: a result or its cost is no finite number, or the cost is below 0 or above the limit."""
    fee = F.col("commission_r")
    broken = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return reduce(or_, [broken(F.col(c)) for c in ("commission_r", *results)]) | (fee < 0) | (fee > limit)


def figures(rows: DataFrame) -> DataFrame:
    """Per profile and over all: trades, net_r, win_rate, profit_factor (null without losses) and max_drawdown of the running net result from 0; anomalies apart.

    Both levels are dealt by profile and by day first; a day's running sum, low and high are put together by a window over days.
    """
    rows = kept(rows)
    both = rows.withColumn("profile", F.explode(F.array(F.col("profile"), F.lit("all")))).withColumn("_odd", anomaly())
    sane = both.where("not _odd").withColumn("_day", F.floor(F.col("closed_at_ms") / 86_400_000))
    inside = Window.partitionBy("profile", "_day").orderBy("closed_at_ms", "key").rowsBetween(Window.unboundedPreceding, 0)
    days = sane.groupBy("profile", "_day").agg(F.sum("net_r").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("profile").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    curve = sane.withColumn("_own", F.sum("net_r").over(inside)).join(days.select("profile", "_day", before.alias("_before")), ["profile", "_day"]).withColumn("_curve", F.col("_before") + F.col("_own"))
    top = curve.withColumn("_top", F.max("_curve").over(inside))
    tops = top.groupBy("profile", "_day").agg(F.max("_curve").alias("_high"))
    earlier = F.max("_high").over(Window.partitionBy("profile").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    top = top.join(tops.select("profile", "_day", earlier.alias("_earlier")), ["profile", "_day"])
    fall = F.greatest(F.lit(0.0), F.col("_top"), F.coalesce("_earlier", F.lit(0.0))) - F.col("_curve")
    won, lost = F.sum(F.when(F.col("net_r") > 0, F.col("net_r"))), F.sum(F.when(F.col("net_r") < 0, -F.col("net_r")))
    out = top.groupBy("profile").agg(F.count(F.lit(1)).alias("trades"), F.sum("net_r").alias("net_r"), (F.count(F.when(F.col("net_r") > 0, 1)) / F.count(F.lit(1))).alias("win_rate"), (F.coalesce(won, F.lit(0.0)) / lost).alias("profit_factor"), F.max(fall).alias("max_drawdown"))
    odd = both.groupBy("profile").agg(F.count(F.when(F.col("_odd"), 1)).alias("anomalies"))
    return odd.join(out, "profile", "left")


def walk_forward(rows: DataFrame, span_days: int = 28, train: int = 4) -> DataFrame:
    """Out-of-sample figures of rolling folds, of closed setups (profile, symbol, closed_at_ms, gross_r, commission_r, net_r).

    Time is cut into spans counted from 1970; fold n is tested on span n and trained on the `train` spans before it. A symbol is
    chosen for a fold and profile if its mean net_r in training is above 0. Returned per fold and profile with trades on both
    sides: fold, train_trades, test_trades, expectancy (of all test trades), chosen (symbols), chosen_trades and
    chosen_expectancy (of their test trades, null without any). Anomalies and rows without a time take no part, nulls in
    profile or symbol are a group. A row goes into its train + 1 folds as it is read, so all folds are dealt in one shuffle
    of partial sums.
    """
    span = F.floor(F.col("closed_at_ms") / (span_days * 86_400_000))
    sane = rows.where(~anomaly() & F.col("closed_at_ms").isNotNull())
    dealt = sane.select("profile", "symbol", "net_r", span.alias("_span"), F.explode(F.sequence(F.lit(0), F.lit(train))).alias("_back"))
    tested = F.col("_back") == 0
    count = lambda of: F.count(F.when(of, 1))
    total = lambda of: F.coalesce(F.sum(F.when(of, F.col("net_r"))), F.lit(0.0))
    each = dealt.groupBy((F.col("_span") + F.col("_back")).alias("fold"), "profile", "symbol").agg(count(~tested).alias("_n"), total(~tested).alias("_r"), count(tested).alias("_m"), total(tested).alias("_out"))
    chosen = (F.col("_n") > 0) & (F.col("_r") > 0)
    taken = F.coalesce(F.sum(F.when(chosen, F.col("_m"))), F.lit(0))
    folds = each.groupBy("fold", "profile").agg(
        F.sum("_n").alias("train_trades"), F.sum("_m").alias("test_trades"), (F.sum("_out") / F.sum("_m")).alias("expectancy"),
        count(chosen).alias("chosen"), taken.alias("chosen_trades"), (F.sum(F.when(chosen, F.col("_out"))) / F.when(taken > 0, taken)).alias("chosen_expectancy"))
    return folds.where("train_trades > 0 and test_trades > 0")
