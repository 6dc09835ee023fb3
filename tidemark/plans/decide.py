"""Decisions over setup candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import risk

#: Least score of each profile and whether it needs the extra confirmation.
THRESHOLD = {"scalp": 6, "intraday": 6}
MAX_ACTIVE = 8


def eligibility(rows: DataFrame, tick: Column, least: float = risk.MINIMUM_RR) -> DataFrame:
    """rows with score, risk_reward, entry_limit, all reasons against a candidate in order, and status.

    Columns that rows lack count as fulfilled: higher_timeframe_bias, premium_discount, zone_intersects_ote,
    confirmation_aligned, extra_confirmed, data_fresh, market_open, duplicate, cooldown_active, active_count, minimum_stop.
    MISSED_PRICE only if the price beyond the entry limit is the one reason.
    """
    has = set(rows.columns)
    col = lambda name, default: F.coalesce(F.col(name), ~F.lit(default)) if name in has else F.lit(default)
    side = risk.side(F.col("direction"))
    rows = rows.withColumn("score", risk.total(risk.score("evidence")))
    rows = rows.withColumn("risk_reward", risk.risk_reward(F.col("direction"), F.col("confirmation_price"), F.col("stop_price"), F.col("target")))
    rows = rows.withColumn("entry_limit", risk.entry_limit(F.col("direction"), F.col("target"), F.col("stop_price"), tick, least))
    priced = F.col("risk_reward").isNotNull() & F.col("entry_limit").isNotNull()
    known = F.lower("profile").isin(*THRESHOLD)
    missed = priced & (side * (F.col("current_price") - F.col("entry_limit")) > 0)
    checks = [
        (~F.col("direction").isin("long", "short"), "invalid_direction"),
        (F.col("higher_timeframe_bias") != F.col("direction") if "higher_timeframe_bias" in has else F.lit(False), "higher_timeframe_bias_conflict"),
        (F.col("premium_discount") != F.when(F.col("direction") == "long", "discount").otherwise("premium") if "premium_discount" in has else F.lit(False), "wrong_premium_discount_zone"),
        (~col("zone_intersects_ote", True), "zone_does_not_intersect_ote"),
        (~F.col("evidence.liquidity_sweep"), "liquidity_sweep_missing"),
        (~col("confirmation_aligned", True), "confirmation_not_aligned"),
        (~known, "invalid_profile"),
        ((F.lower("profile") == "scalp") & ~col("extra_confirmed", True), "one_minute_confirmation_missing"),
        (F.col("score") < F.create_map(*[F.lit(x) for kv in THRESHOLD.items() for x in kv])[F.lower("profile")], "score_below_threshold"),
        (~col("data_fresh", True), "market_data_stale_or_incomplete"),
        (~col("market_open", True), "tradfi_market_closed"),
        (col("duplicate", False), "duplicate_setup"),
        (col("cooldown_active", False), "cooldown_active"),
        (F.col("active_count") < 0 if "active_count" in has else F.lit(False), "invalid_active_count"),
        (F.col("active_count") >= MAX_ACTIVE if "active_count" in has else F.lit(False), "active_setup_limit_reached"),
        (F.abs(F.col("confirmation_price") - F.col("stop_price")) < F.col("minimum_stop") if "minimum_stop" in has else F.lit(False), "stop_distance_below_minimum"),
        (priced & (F.col("risk_reward") < least), "risk_reward_below_minimum"),
        (missed, "price_beyond_acceptable_entry"),
        (~priced, "invalid_price_or_risk_parameters"),
    ]
    rows = rows.withColumn("reasons", F.array_compact(F.array(*[F.when(c, r) for c, r in checks])))
    return rows.withColumn("status", F.when(F.size("reasons") == 0, "ELIGIBLE").when((F.size("reasons") == 1) & missed, "MISSED_PRICE").otherwise("REJECTED"))


def gate(rows: DataFrame, now_ms: Column, length_ms: Column, slack_ms: int = 120_000, least: float = risk.MINIMUM_RR) -> DataFrame:
    """rows of the price-action scan with zone_key, fresh, status and decision_reason: the first gate that holds rejects.

    Gates: no target, no tick size, no confirmation data (last_close_ms null), hours unverified (market_open null and
    needs_hours), market closed, then freshness, risk, reward, target side and tick together.
    """
    entry, stop, target = F.col("confirmation_price"), F.col("stop_price"), F.col("target")
    fresh = now_ms - F.col("last_close_ms") <= length_ms + slack_ms
    risked = F.abs(entry - stop)
    fine = fresh & (risked > 0) & (F.abs(target - entry) / F.when(risked > 0, risked) >= least) & (risk.side(F.col("direction")) * (target - entry) > 0) & (F.col("tick_size") > 0)
    reason = F.when(target.isNull(), "tp1_target_missing").when(F.col("tick_size").isNull(), "tick_size_unavailable").when(F.col("last_close_ms").isNull(), "confirmation_data_missing").when(F.col("needs_hours") & F.col("market_open").isNull(), "market_hours_unverified").when(F.col("needs_hours") & ~F.col("market_open"), "tradfi_market_closed").when(~F.coalesce(fine, F.lit(False)), "pac_invalid_risk_target_or_rr")
    key = F.concat_ws(":", "symbol", "profile", "direction", F.format_string("%.8f", F.col("zone_low")), F.format_string("%.8f", F.col("zone_high")))
    return rows.withColumn("zone_key", key).withColumn("fresh", fresh).withColumn("decision_reason", reason).withColumn("status", F.when(F.col("decision_reason").isNull(), "ACCEPTED").otherwise("REJECTED"))
