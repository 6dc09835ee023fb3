"""Multi-timeframe setup scans: every trigger bar is a snapshot, and one plan scans all of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import risk
from ..operators import alive, chunks, indicators, liquidity, ranges, structure, zones
from ..operators.crossing import asof
from ..operators.shared import kept
from ..sources.bars import SERIES
from . import targets as aims


@dataclass(frozen=True)
class Profile:
    """Timeframes, swing widths and limits of a scan."""

    name: str
    bias: str
    zone: str
    trigger: str
    extra: str | None = None
    width: int = 2
    stop_buffer: float = 0.3
    min_rr: float = risk.MINIMUM_RR
    threshold: int = 6


PROFILES = {"scalp": Profile("scalp", "1h", "15m", "5m", "1m", 2), "intraday": Profile("intraday", "4h", "1h", "15m", None, 3)}
HISTORY = 40


@dataclass(frozen=True)
class Options:
    """Switches of the price-action scan; the defaults are the active strategy."""

    trigger_gate: bool = True
    require_extra: bool = False
    synthetic_2r: bool = True
    skip_near_targets: bool = True
    strict_retest: bool = False
    max_chase_atr: float = 2.0
    enforce_threshold: bool = False
    pick_retested: bool = False


def facts(bars: DataFrame, timeframe: str, width: int) -> dict[str, DataFrame]:
    """What one timeframe's bars say, each computed once over the whole history with the time it became known."""
    own = bars.where(F.col("timeframe") == timeframe)
    points = kept(structure.swings(own, width, width))
    events = kept(structure.breaks(own, points))
    return {"bars": own, "swings": points, "breaks": events}


def swept(bars: DataFrame, pools: DataFrame, within: int = 12) -> DataFrame:
    """symbol, i and direction of bars within so many bars after a sweep that was visible then.

    Sweeps of the day's own extremes and of earlier days' stay visible; a pool's only while its version is the current one.
    """
    days = liquidity.sweeps(bars, liquidity.previous_days(bars).drop("known_at"), ["kind", "confirmation_index"]).select("symbol", "candle_index", "direction", F.lit(None).cast("int").alias("until"))
    held = liquidity.sweeps(bars, pools, ["pool", "version"]).where(F.col("superseded_at").isNull() | (F.col("candle_index") < F.col("superseded_at"))).select("symbol", "candle_index", "direction", (F.col("superseded_at") - 1).alias("until"))
    own = liquidity.intraday_sweeps(bars).select("symbol", "candle_index", "direction", F.lit(None).cast("int").alias("until"))
    rows = days.unionByName(held).unionByName(own)
    last = F.least(F.col("candle_index") + within, F.coalesce("until", F.lit(2**31 - 1 - within)))
    return rows.select("symbol", "direction", F.explode(F.sequence("candle_index", last)).alias("i")).distinct()


def snapshots(bars: DataFrame, profile: Profile) -> tuple[DataFrame, dict]:
    """One row per trigger bar: its own values and, as of its close, what the other timeframes know."""
    bars = kept(bars.where(F.col("timeframe").isin(*{profile.bias, profile.zone, profile.trigger, profile.extra or profile.trigger})))
    bias, zone, trigger = facts(bars, profile.bias, profile.width), facts(bars, profile.zone, profile.width), facts(bars, profile.trigger, 2)
    own = indicators.average_volume(indicators.atr(structure.internal_direction(trigger["bars"])))
    event = trigger["breaks"].select("symbol", F.col("candle_index").alias("i"), F.struct("candle_index", "direction", "event_open_ms", F.col("known_at").alias("at")).alias("_e"))
    own = chunks.so_far(kept(own.join(event, ["symbol", "i"], "left")), {"_before": ("last", F.col("_e"))}).withColumn("trigger_break", F.coalesce("_e", "_before"))
    own = chunks.with_halo(own, before=9)
    for n in (6, 10):
        last = chunks.inside().rowsBetween(-n + 1, 0)
        own = own.withColumn(f"low_{n}", F.min("low").over(last)).withColumn(f"high_{n}", F.max("high").over(last))
    own = chunks.own(own)
    rows = own.select("symbol", "i", F.col("open_time_ms").alias("open_ms"), F.col("close_time_ms").alias("t"), F.col("close").alias("entry"), "volume", "atr", "average_volume", "internal_direction", "trigger_break", "low_6", "high_6", "low_10", "high_10")
    for name, side in (("bias", bias), ("zone", zone)):
        rows = asof(rows, side["bars"], ["symbol"], "t", "close_time_ms", f"{name}_bar", ["i", "close", "close_time_ms"])
        rows = asof(rows, side["breaks"], ["symbol"], "t", "known_at", f"{name}_break", ["direction", "candle_index"], ["candle_index"])
    rows = asof(rows, ranges.leg_versions(bias["swings"]), ["symbol"], "t", "known_at", "bias_legs", ["bullish", "bearish"], ["nth"])
    rows = asof(rows, ranges.leg_versions(zone["swings"]), ["symbol"], "t", "known_at", "zone_legs", ["bullish", "bearish"], ["nth"])
    if profile.extra:
        extra = facts(bars, profile.extra, 2)
        rows = asof(rows, extra["bars"], ["symbol"], "t", "close_time_ms", "extra_bar", ["i", "close_time_ms"])
        rows = asof(rows, extra["breaks"], ["symbol"], "t", "known_at", "extra_break", ["direction", "candle_index"], ["candle_index"])
    else:
        rows = rows.withColumn("extra_bar", F.lit(None).cast("struct<i:int,close_time_ms:bigint>")).withColumn("extra_break", F.lit(None).cast("struct<direction:string,candle_index:int>"))
    rows = kept(rows)
    found = zones.zones(zone["bars"], zones.order_blocks(zone["bars"], zone["breaks"]), zones.gaps(zone["bars"]))
    found = kept(alive.on_bars(found.drop("timeframe"), trigger["bars"], ["symbol"]))
    pools = kept(liquidity.pools(trigger["swings"], own.select(*SERIES, "i", "atr"), members=False))
    return rows, {"zones": found, "pools": pools, "trigger": trigger, "sizes": alive.heights(rows)}


ZONE = ("rank", "formed", "zone_kind", "zone_low", "zone_high", "zone_open_ms", "zone_close_ms")


def zone_facts(found: DataFrame) -> DataFrame:
    """Zones as facts: symbol, expected (their direction), ZONE, from_i and until_i."""
    return found.select("symbol", F.col("direction").alias("expected"), "rank", "formed", "zone_kind", F.col("lower").alias("zone_low"), F.col("upper").alias("zone_high"), "zone_open_ms", "zone_close_ms", "from_i", "until_i")


def nearby_zones(rows: DataFrame, facts: DataFrame, sizes: int) -> DataFrame:
    """symbol, i and zone (struct of ZONE): of each row (symbol, expected, i, entry, low_6, high_6) the zones alive that the last six bars touch, and the nearest ones above and below the entry.

    Among these are the nearest zone of all and every retested one.
    """
    by, whole = ["symbol", "expected"], F.struct(*ZONE)
    touched = alive.touching(rows.select(*by, "i", "low_6", "high_6"), facts, by, ("low_6", "high_6"), ("zone_low", "zone_high"), sizes).select("symbol", "i", whole.alias("zone"))
    for up, edge in ((True, "zone_low"), (False, "zone_high")):
        asked = rows.select(*by, "i", F.lit(up).alias("up"), F.col("entry").alias("edge"))
        found = alive.nearest(asked, facts.select(*by, "from_i", "until_i", F.col(edge).alias("price"), whole.alias("payload")), by, sizes, 1)
        touched = touched.unionByName(found.select("symbol", "i", F.col("near")[0]["payload"].alias("zone")))
    return touched


def first_reason(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(c, r) for c, r in checks])


def leg_range(name: str, direction: Column) -> Column:
    return ranges.range_of(F.when(direction == "bullish", F.col(f"{name}.bullish")).otherwise(F.col(f"{name}.bearish")))


def live_levels(trigger: dict, pools: DataFrame) -> DataFrame:
    """symbol, price and the bars from and until which a liquidity level of the trigger timeframe stands."""
    a = pools.select("symbol", "price", F.col("confirmation_index").alias("from_i"), F.col("superseded_at").alias("until_i"))
    b = liquidity.previous_days(trigger["bars"]).select("symbol", "price", (F.col("confirmation_index") + 1).alias("from_i"), F.lit(None).cast("int").alias("until_i"))
    w = Window.partitionBy("symbol", liquidity.day_of()).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    day = trigger["bars"].select("symbol", "i", F.max("high").over(w).alias("h"), F.min("low").over(w).alias("l")).where("h is not null")
    c = day.select("symbol", F.explode(F.array("h", "l")).alias("price"), F.col("i").alias("from_i"), (F.col("i") + 1).alias("until_i"))
    return a.unionByName(b).unionByName(c)


def last_bars(bars: DataFrame, n: int, name: str) -> DataFrame:
    """symbol, i and the last n bars (fewer at the start) of one timeframe as an array of t, low_1 and high_1."""
    near = chunks.with_halo(bars.select(*SERIES, "i", F.struct(F.col("close_time_ms").alias("t"), F.col("low").alias("low_1"), F.col("high").alias("high_1")).alias("_bar")), before=n - 1)
    return chunks.own(near.withColumn(name, F.collect_list("_bar").over(chunks.inside().rowsBetween(1 - n, 0)))).select("symbol", "i", name)


def price_action(bars: DataFrame, profile: Profile, options: Options = Options()) -> DataFrame:
    """Every snapshot of the price-action scan with reason (the first gate that rejects it, or pac_candidate_generated) and, for candidates, their fields.

    Rejected snapshots stay in the plan but meet no zone and no level: the joins' conditions leave them out, so
    that the costly joins only see what the cheap gates let through.
    """
    rows, known = snapshots(bars, profile)
    rows = rows.withColumn("expected", F.col("bias_break.direction")).withColumn("direction", F.when(F.col("expected") == "bullish", "long").when(F.col("expected") == "bearish", "short"))
    long = F.col("direction") == "long"
    rows = rows.withColumn("reason", first_reason((F.col("i") < HISTORY - 1, "insufficient_trigger_history"), (F.coalesce(F.least(F.coalesce("zone_bar.i", F.lit(-1)), F.coalesce("bias_bar.i", F.lit(-1))), F.lit(-1)) < HISTORY - 1, "insufficient_mtf_history"), (F.col("expected").isNull(), "no_htf_bias"), (~F.coalesce(F.col("atr") > 0, F.lit(False)), "invalid_atr")))
    recent = []
    if options.strict_retest:
        rows, recent = rows.join(last_bars(known["trigger"]["bars"], 6, "recent"), ["symbol", "i"]), ["recent"]
    rows = kept(rows)
    waiting = rows.where("reason is null").select("symbol", "i", "expected", "entry", "atr", "low_6", "high_6", "trigger_break", *recent)
    near = waiting.join(nearby_zones(waiting, zone_facts(known["zones"]), known["sizes"]), ["symbol", "i"]).select("*", "zone.*")
    inside = (F.col("zone_low") <= F.col("entry")) & (F.col("entry") <= F.col("zone_high"))
    distance = F.when(inside, 0.0).otherwise(F.least(F.abs(F.col("entry") - F.col("zone_low")), F.abs(F.col("entry") - F.col("zone_high"))) / F.greatest(F.col("atr"), F.lit(1e-12)))
    touched = (F.col("high_6") >= F.col("zone_low")) & (F.col("low_6") <= F.col("zone_high"))
    if options.strict_retest:
        # the touch itself must come after both the zone's candle and the break
        touched = F.exists("recent", lambda b: (b["t"] > F.greatest(F.col("zone_close_ms"), F.col("trigger_break.at"))) & (b["high_1"] >= F.col("zone_low")) & (b["low_1"] <= F.col("zone_high"))) & F.col("trigger_break.at").isNotNull()
    order = F.struct(F.when(~(inside | touched) if options.pick_retested else F.lit(False), 1).otherwise(0), distance, "rank", "formed")
    pick = F.struct("zone_kind", "zone_low", "zone_high", "formed", "zone_open_ms", "zone_close_ms", distance.alias("distance"), touched.alias("retested"), inside.alias("inside"))
    rows = rows.join(near.groupBy("symbol", "i").agg(F.min_by(pick, order).alias("z")), ["symbol", "i"], "left")
    buffer = risk.stop_buffer(F.col("symbol"), F.lit(profile.stop_buffer)) * F.col("atr")
    first = F.when(long, F.col("z.zone_low") - buffer).otherwise(F.col("z.zone_high") + buffer)
    wrong = F.when(long, first >= F.col("entry")).otherwise(first <= F.col("entry"))
    stop = F.when(wrong, F.when(long, F.col("low_10") - buffer).otherwise(F.col("high_10") + buffer)).otherwise(first)
    rows = rows.withColumn("stop_price", stop).withColumn("risk", F.abs(F.col("entry") - F.col("stop_price")))
    rows = rows.withColumn("reason", F.coalesce("reason", first_reason((F.col("z").isNull(), "no_directional_ob_fvg"), (~(F.col("z.inside") | F.col("z.retested")) | (F.col("z.distance") > options.max_chase_atr), "zone_not_recently_retested"), (F.col("risk") <= 0, "invalid_stop"))))
    rows = kept(rows)
    sign = risk.side(F.col("direction"))
    waiting = rows.where("reason is null").select("symbol", "i", "direction", "entry", "risk")
    least = risk.MINIMUM_RR * F.col("risk")
    edge = aims.past(F.col("entry"), sign, least) if options.skip_near_targets else F.col("entry")
    ahead = aims.levels_ahead(waiting, live_levels(known["trigger"], known["pools"]), known["sizes"], edge, aims.SPARE)
    rows = rows.join(ahead.select("symbol", "i", "prices"), ["symbol", "i"], "left")
    away = F.array_distinct(F.transform(F.coalesce("prices", F.array().cast("array<double>")), lambda p: F.abs(p - F.col("entry"))))
    far = F.filter(away, lambda x: x >= least) if options.skip_near_targets else away
    rows = rows.withColumn("_d", F.slice(far, 1, 3)).drop("prices")
    fallback = F.array(2.0 * F.col("risk")) if options.synthetic_2r else F.array().cast("array<double>")
    rows = rows.withColumn("_d", F.when(F.size("_d") > 0, F.col("_d")).otherwise(fallback)).withColumn("risk_reward", F.get("_d", F.lit(0)) / F.col("risk"))
    rows = rows.withColumn("targets", F.transform("_d", lambda x: F.col("entry") + sign * x)).drop("_d")
    age = F.col("i") - F.col("trigger_break.candle_index")
    trigger = F.coalesce((F.col("trigger_break.direction") == F.col("expected")) & age.between(0, 3), F.lit(False))
    extra_age = F.col("extra_bar.i") - F.col("extra_break.candle_index")
    extra = F.coalesce((F.col("extra_break.direction") == F.col("expected")) & extra_age.between(0, 4), F.lit(False))
    band = leg_range("bias_legs", F.col("expected"))
    place = ranges.premium_discount(F.col("bias_bar.close"), band["equilibrium"])
    sweep = swept(known["trigger"]["bars"], known["pools"]).select("symbol", "i", F.col("direction").alias("expected"), F.lit(True).alias("_swept"))
    rows = rows.join(sweep, ["symbol", "i", "expected"], "left")
    flags = {
        "trigger_structure_aligned": trigger,
        "internal_structure_aligned": F.coalesce(F.col("internal_direction") == F.col("expected"), F.lit(False)),
        "liquidity_sweep": F.coalesce("_swept", F.lit(False)),
        "zone_timeframe_structure_aligned": F.coalesce(F.col("zone_break.direction") == F.col("expected"), F.lit(False)),
        "premium_discount_aligned": F.coalesce(place == F.when(long, "discount").otherwise("premium"), F.lit(False)),
        "extra_confirmation_aligned": extra,
    }
    rows = rows.withColumns(flags).drop("_swept")
    base = 4 if options.trigger_gate else 3
    rows = rows.withColumn("score", F.least(F.lit(10), sum((F.col(c).cast("int") for c in flags), F.lit(base))))
    gates = [(~F.coalesce(F.col("risk_reward") >= risk.MINIMUM_RR, F.lit(False)), "risk_reward_below_minimum")]
    if options.trigger_gate:
        gates.append((~F.col("trigger_structure_aligned"), "no_recent_trigger_structure"))
    if options.require_extra and profile.extra:
        gates.append((~F.col("extra_confirmation_aligned"), "missing_current_extra_confirmation"))
    if options.enforce_threshold:
        gates.append((F.col("score") < profile.threshold, "score_below_threshold"))
    rows = rows.withColumn("reason", F.coalesce("reason", first_reason(*gates), F.lit("pac_candidate_generated")))
    event = F.when(F.col("trigger_structure_aligned"), F.col("trigger_break.event_open_ms")).otherwise(F.col("open_ms"))
    key = F.concat_ws(":", "symbol", F.lit(profile.name), "direction", F.lit("PAC"), F.col("z.zone_kind"), F.col("z.zone_open_ms").cast("string"), event.cast("string"))
    named = {"trigger_structure_aligned": "pac_trigger_structure_aligned", "internal_structure_aligned": "pac_internal_structure_aligned", "liquidity_sweep": "pac_liquidity_sweep_confluence", "premium_discount_aligned": "pac_premium_discount_confluence"}
    reasons = F.array_compact(F.array(F.lit("pac_htf_structure_bias"), F.concat(F.lit("pac_"), F.lower("z.zone_kind"), F.lit("_zone")), F.lit("pac_zone_retest_or_nearby"), F.lit("pac_atr_stop"), F.lit("pac_target_and_rr"), *[F.when(F.col(c), r) for c, r in named.items()]))
    made = F.col("reason") == "pac_candidate_generated"
    return rows.select("symbol", F.lit(profile.name).alias("profile"), F.col("t").alias("confirmation_time_ms"), F.col("i").alias("confirmation_index"), "reason", F.when(made, key).alias("key"), "direction", F.col("entry").alias("confirmation_price"), "stop_price", "targets", "risk_reward", "score", "atr", F.col("z.zone_low").alias("zone_low"), F.col("z.zone_high").alias("zone_high"), F.col("z.distance").alias("zone_distance_atr"), *flags, F.when(made, reasons).alias("reasons"))


def structure_scan(bars: DataFrame, profile: Profile) -> DataFrame:
    """Every snapshot of the sweep, break and retest scan with reason (the first gate that rejects it, or candidate_generated), score and key."""
    rows, known = snapshots(bars, profile)
    trigger = known["trigger"]
    rows = rows.withColumn("expected", F.col("bias_break.direction")).withColumn("direction", F.when(F.col("expected") == "bullish", "long").when(F.col("expected") == "bearish", "short"))
    long = F.col("direction") == "long"
    sweeps = liquidity.intraday_sweeps(trigger["bars"]).select("symbol", "candle_index", "direction", "level").unionByName(liquidity.sweeps(trigger["bars"], liquidity.previous_days(trigger["bars"]).drop("known_at"), ["kind", "confirmation_index"]).select("symbol", "candle_index", "direction", F.col("price").alias("level")))
    sweeps = sweeps.withColumn("from_i", F.col("candle_index")).withColumn("until_i", F.lit(None).cast("int")).unionByName(liquidity.sweeps(trigger["bars"], known["pools"], ["pool", "version"]).where(F.col("superseded_at").isNull() | (F.col("candle_index") < F.col("superseded_at"))).select("symbol", "candle_index", "direction", F.col("price").alias("level"), F.col("candle_index").alias("from_i"), F.col("superseded_at").alias("until_i")))
    sweeps = kept(sweeps)
    seen = alive.counts(rows, sweeps, ["symbol"], known["sizes"], F.count(F.lit(1)).alias("sweeps"))
    rows = rows.join(seen, ["symbol", "i"], "left")
    rows = rows.withColumn("bias_range", leg_range("bias_legs", F.col("expected"))).withColumn("zone_range", leg_range("zone_legs", F.col("expected")))
    age = F.col("i") - F.col("trigger_break.candle_index")
    history = F.least(F.col("i"), F.coalesce("zone_bar.i", F.lit(-1)), F.coalesce("bias_bar.i", F.lit(-1)))
    rows = rows.withColumn("reason", first_reason((history < HISTORY - 1, "insufficient_history"), (F.col("expected").isNull(), "no_htf_structure_break"), (F.col("sweeps").isNull(), "no_liquidity_sweep"), (F.col("trigger_break").isNull(), "no_structure_break"), (F.col("bias_range").isNull(), "no_directional_bias_dealing_range"), (F.col("zone_range").isNull(), "no_directional_zone_dealing_range"), (~age.between(0, 2), "confirmation_break_not_recent"), (F.col("trigger_break.direction") != F.col("expected"), "confirmation_direction_mismatch")))
    # bars since the break, two at most: the zone must be touched by one that closed after both break and zone
    rows = kept(rows.join(last_bars(trigger["bars"], 3, "_recent"), ["symbol", "i"]))
    waiting = rows.where("reason is null").select("symbol", "i", "expected", "trigger_break", "_recent", F.col("zone_range.ote_lower").alias("ote_lower"), F.col("zone_range.ote_upper").alias("ote_upper"))
    near = alive.touching(waiting, zone_facts(known["zones"]), ["symbol", "expected"], ("ote_lower", "ote_upper"), ("zone_low", "zone_high"), known["sizes"])
    touched = F.exists("_recent", lambda b: (b["t"] > F.greatest(F.col("trigger_break.at"), F.col("zone_close_ms"))) & (b["high_1"] >= F.col("zone_low")) & (b["low_1"] <= F.col("zone_high")))
    usable = F.coalesce(touched, F.lit(False))
    ob = F.col("zone_kind") == "OB"
    spans = lambda flag, name: F.collect_list(F.when(flag, F.struct("zone_low", "zone_high"))).alias(name)
    zone_pick = F.struct("zone_kind", "zone_low", "zone_high", "formed", "zone_open_ms", "zone_close_ms")
    picked = near.groupBy("symbol", "i").agg(F.max_by(F.when(usable, zone_pick), F.when(usable, F.struct("formed", "zone_kind"))).alias("z"), spans(ob, "_obs"), spans(~ob, "_fvgs"))
    rows = rows.join(picked, ["symbol", "i"], "left")
    zone_atr = indicators.atr(bars.where(F.col("timeframe") == profile.zone)).select("symbol", F.col("i").alias("_formed"), F.col("atr").alias("zone_atr"))
    rows = rows.withColumn("_formed", F.col("z.formed")).join(zone_atr, ["symbol", "_formed"], "left")
    rows = rows.withColumn("reason", F.coalesce("reason", first_reason((F.col("z").isNull(), "no_active_zone_retested_after_confirmation"), (~F.coalesce(F.col("zone_atr") > 0, F.lit(False)), "invalid_zone_atr"))))
    rows = kept(rows)
    waiting = rows.where("reason is null").select("symbol", "i", "expected", F.col("trigger_break.candle_index").alias("break_index"), "z.zone_low", "z.zone_high", "zone_atr")
    reach = F.col("zone_atr") * (1 + 1e-9)
    waiting = waiting.withColumn("_low", F.col("zone_low") - reach).withColumn("_high", F.col("zone_high") + reach)
    s = sweeps.select("symbol", F.col("direction").alias("expected"), "candle_index", "level", "from_i", "until_i")
    prior = alive.touching(waiting, s, ["symbol", "expected"], ("_low", "_high"), ("level", "level"), known["sizes"])
    prior = prior.where((F.col("candle_index") < F.col("break_index")) & liquidity.near_zone(F.col("level"), F.col("zone_low"), F.col("zone_high"), F.col("zone_atr"), 1.0))
    rows = rows.join(prior.groupBy("symbol", "i").agg(F.max("candle_index").alias("sweep_index")), ["symbol", "i"], "left")
    extremes = trigger["bars"].select("symbol", F.col("i").alias("sweep_index"), F.col("low").alias("_sl"), F.col("high").alias("_sh"))
    rows = rows.join(extremes, ["symbol", "sweep_index"], "left")
    buffer = risk.stop_buffer(F.col("symbol"), F.lit(profile.stop_buffer)) * F.col("atr")
    rows = rows.withColumn("stop_price", F.when(long, F.col("_sl") - buffer).otherwise(F.col("_sh") + buffer))
    wrong = F.when(long, F.col("stop_price") >= F.col("entry")).otherwise(F.col("stop_price") <= F.col("entry"))
    rows = rows.withColumn("reason", F.coalesce("reason", first_reason((F.col("sweep_index").isNull(), "no_prior_directional_sweep_near_zone"), (~F.coalesce(F.col("atr") > 0, F.lit(False)), "invalid_atr"), (wrong, "invalid_stop"))))
    rows = kept(rows)
    waiting = rows.where("reason is null").select("symbol", "i", "direction", "entry")
    aimed = aims.tiered(waiting, live_levels(trigger, known["pools"]), trigger["swings"], known["sizes"])
    rows = rows.join(aimed.drop("direction"), ["symbol", "i"], "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<double>")))
    rows = rows.withColumn("risk_reward", F.abs(F.get("targets", F.lit(0)) - F.col("entry")) / F.abs(F.col("entry") - F.col("stop_price")))
    rows = kept(rows)
    opposing = zones.zones(trigger["bars"], zones.order_blocks(trigger["bars"], trigger["breaks"]), zones.gaps(trigger["bars"]))
    opposing = zone_facts(alive.on_bars(opposing.drop("timeframe"), trigger["bars"], ["symbol"])).select("symbol", F.when(F.col("expected") == "bullish", "bearish").otherwise("bullish").alias("expected"), "zone_low", "zone_high", "from_i", "until_i")
    tp = F.get("targets", F.lit(0))
    waiting = rows.where(F.col("reason").isNull() & tp.isNotNull()).select("symbol", "i", "expected", "direction", "entry", tp.alias("tp"), F.least("entry", tp).alias("_low"), F.greatest("entry", tp).alias("_high"))
    between = F.when(long, (F.col("zone_high") > F.col("entry")) & (F.col("zone_low") < F.col("tp"))).otherwise((F.col("zone_low") < F.col("entry")) & (F.col("zone_high") > F.col("tp")))
    blocked = alive.touching(waiting, opposing, ["symbol", "expected"], ("_low", "_high"), ("zone_low", "zone_high"), known["sizes"]).where(between).select("symbol", "i", F.lit(False).alias("clean_path")).distinct()
    rows = rows.join(blocked, ["symbol", "i"], "left").withColumn("clean_path", F.coalesce("clean_path", F.lit(True)))
    extra_age = F.col("extra_bar.i") - F.col("extra_break.candle_index")
    gates = [(F.size("targets") == 0, "no_target_liquidity"), (~F.coalesce(F.col("risk_reward") >= profile.min_rr, F.lit(False)), "risk_reward_below_minimum")]
    if profile.extra:
        gates += [(~F.coalesce((F.col("extra_break.direction") == F.col("expected")) & extra_age.between(0, 2), F.lit(False)), "missing_current_extra_confirmation"), (~F.coalesce((F.col("t") - F.col("extra_bar.close_time_ms")).between(0, 180_000), F.lit(False)), "stale_extra_confirmation")]
    rows = rows.withColumn("reason", F.coalesce("reason", first_reason(*gates)))
    meet = F.exists("_obs", lambda a: F.exists("_fvgs", lambda b: (a["zone_low"] <= b["zone_high"]) & (b["zone_low"] <= a["zone_high"]) & (F.greatest(a["zone_low"], b["zone_low"]) <= F.col("zone_range.ote_upper")) & (F.least(a["zone_high"], b["zone_high"]) >= F.col("zone_range.ote_lower"))))
    place = ranges.premium_discount(F.col("bias_bar.close"), F.col("bias_range.equilibrium"))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    internal = F.when(F.col("internal_direction") == F.col("expected"), 1).when(F.col("internal_direction").isNotNull(), -1).otherwise(0)
    score = F.lit(5) + 2 * one(meet) + one(F.col("zone_break.direction") == F.col("expected")) + one(F.col("clean_path")) + one(place == F.when(long, "discount").otherwise("premium")) + internal + one((F.col("average_volume") > 0) & (F.col("volume") > 1.5 * F.col("average_volume")))
    rows = rows.withColumn("score", F.least(F.lit(10), score))
    rows = rows.withColumn("reason", F.coalesce("reason", first_reason((F.col("score") < profile.threshold, "score_below_threshold")), F.lit("candidate_generated")))
    key = F.concat_ws(":", "symbol", F.lit(profile.name), "direction", F.col("z.zone_kind"), F.col("z.zone_open_ms").cast("string"), F.col("trigger_break.event_open_ms").cast("string"))
    return rows.select("symbol", F.lit(profile.name).alias("profile"), F.col("t").alias("confirmation_time_ms"), F.col("i").alias("confirmation_index"), "reason", F.when(F.col("reason") == "candidate_generated", key).alias("key"), "direction", F.col("entry").alias("confirmation_price"), "stop_price", "targets", "risk_reward", "score", "atr", F.col("z.zone_low").alias("zone_low"), F.col("z.zone_high").alias("zone_high"), "clean_path")


def funnel(scanned: DataFrame) -> DataFrame:
    """How many snapshots each gate took."""
    return scanned.groupBy("profile", "reason").agg(F.count(F.lit(1)).alias("n"))
