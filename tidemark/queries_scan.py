"""Queries for targets, snapshots and scans, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sql
from .functions import risk
from .operators import alive, indicators, liquidity, ranges, structure, zones
from .operators.crossing import overlapping
from .operators.shared import kept
from .plans import decide, scan, snapshot, targets
from .queries import REC, WITH, pool_versions, query, rounded, series
from .queries_ops import SETUPS, SG, setups
from .sources.bars import SERIES

INTRADAY = scan.PROFILES["intraday"]
PARTS = f"""{sql.bars()}, {sql.swings(2, 2, 's2')}, {sql.swings(3, 3, 's3')}, sw AS (SELECT * FROM s2 WHERE timeframe = '15m' UNION ALL SELECT * FROM s3 WHERE timeframe <> '15m'),
{sql.breaks()}, {sql.BLOCKS}, {sql.MITIGATION}, {sql.GAPS}, {sql.FILLS}, {sql.ZONES}, {sql.atr()}"""
FUNNEL = f"""{PARTS},
sn AS (SELECT symbol, i, close_time_ms AS t, close AS entry, atr, min(low) OVER (PARTITION BY symbol ORDER BY i ROWS 5 PRECEDING) AS l6, max(high) OVER (PARTITION BY symbol ORDER BY i ROWS 5 PRECEDING) AS h6, min(low) OVER (PARTITION BY symbol ORDER BY i ROWS 9 PRECEDING) AS l10, max(high) OVER (PARTITION BY symbol ORDER BY i ROWS 9 PRECEDING) AS h10 FROM a WHERE timeframe = '15m'),
ao AS (SELECT sn.*, (SELECT max(x.i) FROM b x WHERE x.symbol = sn.symbol AND x.timeframe = '1h' AND x.close_time_ms <= t) AS zi, (SELECT max(x.i) FROM b x WHERE x.symbol = sn.symbol AND x.timeframe = '4h' AND x.close_time_ms <= t) AS bi,
      (SELECT arg_max(br.direction, candle_index) FROM br WHERE br.symbol = sn.symbol AND br.timeframe = '4h' AND br.known_at <= t) AS expected, (SELECT arg_max(br.direction, candle_index) FROM br WHERE br.symbol = sn.symbol AND br.timeframe = '15m' AND br.candle_index <= sn.i) AS td, (SELECT max(candle_index) FROM br WHERE br.symbol = sn.symbol AND br.timeframe = '15m' AND br.candle_index <= sn.i) AS tc FROM sn),
pk AS (SELECT ao.*, z.lower, z.upper, greatest(z.lower - entry, entry - z.upper, 0) / greatest(atr, 1e-12) AS dist, row_number() OVER (PARTITION BY ao.symbol, ao.i ORDER BY greatest(z.lower - entry, entry - z.upper, 0) / greatest(atr, 1e-12), z.r1, z.r2, z.formed) AS nth
      FROM ao LEFT JOIN z ON z.symbol = ao.symbol AND z.timeframe = '1h' AND z.direction = ao.expected AND z.known_at <= t AND (z.dead_at IS NULL OR z.dead_at > t)),
st AS (SELECT *, CASE WHEN expected = 'bullish' THEN lower - 0.3 * atr ELSE upper + 0.3 * atr END AS s1 FROM pk WHERE nth = 1),
sp AS (SELECT *, CASE WHEN expected = 'bullish' AND s1 >= entry THEN l10 - 0.3 * atr WHEN expected = 'bearish' AND s1 <= entry THEN h10 + 0.3 * atr ELSE s1 END AS stop FROM st),
rs AS (SELECT *, CASE WHEN i < 39 THEN 'insufficient_trigger_history' WHEN least(coalesce(zi, -1), coalesce(bi, -1)) < 39 THEN 'insufficient_mtf_history' WHEN expected IS NULL THEN 'no_htf_bias' WHEN coalesce(atr, 0) <= 0 THEN 'invalid_atr' WHEN lower IS NULL THEN 'no_directional_ob_fvg'
      WHEN NOT ((lower <= entry AND entry <= upper) OR (h6 >= lower AND l6 <= upper)) OR dist > 2.0 THEN 'zone_not_recently_retested' WHEN abs(entry - stop) <= 0 THEN 'invalid_stop' WHEN NOT coalesce(td = expected AND i - tc BETWEEN 0 AND 3, false) THEN 'no_recent_trigger_structure' ELSE 'pac_candidate_generated' END AS reason FROM sp)"""


def scanned(spark, d, options: scan.Options = scan.Options()):
    return scan.price_action(series(spark, d), INTRADAY, options)


@query("f_price_action_funnel", f"{REC}{FUNNEL} SELECT 'intraday' AS profile, reason, count(*) AS n FROM rs GROUP BY ALL")
def f_funnel(spark, d):
    return scan.funnel(scanned(spark, d))


@query("f1_f10_price_action_gates", f"{REC}{FUNNEL} SELECT symbol, i AS confirmation_index, reason FROM rs")
def f_gates(spark, d):
    return scanned(spark, d).select("symbol", "confirmation_index", "reason")


@query("f11_f13_candidates")
def f_candidates(spark, d):
    return scanned(spark, d).where("key is not null")


@query("f_opt_variant")
def f_variant(spark, d):
    strict = scan.Options(trigger_gate=False, synthetic_2r=False, skip_near_targets=False, strict_retest=True, max_chase_atr=0.75, enforce_threshold=True, pick_retested=True)
    return scan.funnel(scanned(spark, d, strict))


@query("f_scalp_funnel")
def f_scalp(spark, d):
    return scan.funnel(scan.price_action(series(spark, d, ["1m", "5m", "15m", "1h"]), scan.PROFILES["scalp"]))


@query("e_structure_funnel")
def e_funnel(spark, d):
    return scan.funnel(scan.structure_scan(series(spark, d), INTRADAY))


@query("e1_e15_structure_gates")
def e_gates(spark, d):
    return scan.structure_scan(series(spark, d), INTRADAY).select("symbol", "confirmation_index", "reason", "score", "key")


@query("g3_g5_acceptance_gate")
def g3(spark, d):
    rows = scanned(spark, d).where("key is not null").withColumn("target", F.get("targets", F.lit(0)))
    rows = rows.withColumn("tick_size", F.when(F.col("symbol") != "error", 0.01)).withColumn("last_close_ms", F.col("confirmation_time_ms")).withColumn("needs_hours", F.col("symbol") == "view").withColumn("market_open", F.col("confirmation_index") % 2 == 0)
    return decide.gate(rows, F.col("confirmation_time_ms") + 60_000, F.lit(900_000)).select("key", "zone_key", "fresh", "status", "decision_reason")


@query("g4_zone_keys", f"{REC}{SETUPS} SELECT key, symbol || ':' || profile || ':' || direction || ':' || format('{{:.4f}}', round(least(confirmation_price, stop_price), 4)) AS zone_key FROM su")
def g4(spark, d):
    rows = setups(spark, d)
    return rows.select("key", F.concat_ws(":", "symbol", "profile", "direction", F.format_string("%.4f", F.round(F.least("confirmation_price", "stop_price"), 4))).alias("zone_key"))


@query("g7_startup_scan")
def g7(spark, d):
    rows = scanned(spark, d)
    last = rows.groupBy("symbol").agg(F.max("confirmation_index").alias("confirmation_index"))
    return rows.join(last, ["symbol", "confirmation_index"], "left_semi").select("symbol", "profile", "confirmation_time_ms", "reason")


DAYS_AHEAD = f"{REC}{SETUPS}, {sql.DAYS}, lv AS (SELECT su.key, su.direction, confirmation_price AS entry, abs(confirmation_price - stop_price) AS risk, pd.price FROM su JOIN pd ON pd.symbol = su.symbol AND pd.confirmation_index + 1 <= su.confirmation_index AND CASE WHEN su.direction = 'long' THEN pd.price > confirmation_price ELSE pd.price < confirmation_price END)"


def asked(spark, d):
    """Setups, the levels of earlier days as facts, and the node sizes of their bars."""
    bars = series(spark, d, ["15m"])
    rows = kept(setups(spark, d).withColumn("i", F.col("confirmation_index")).withColumn("entry", F.col("confirmation_price")))
    level = liquidity.previous_days(bars).select("symbol", "price", (F.col("confirmation_index") + 1).alias("from_i"), F.lit(None).cast("int").alias("until_i"))
    return rows, level, alive.heights(bars), bars


@query("d1_nearest_targets", f"{DAYS_AHEAD}, o AS (SELECT DISTINCT key, price, abs(price - entry) AS dist FROM lv), t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dist) AS nth FROM o) SELECT key, nth AS rank, price AS target FROM t WHERE nth <= 3")
def d1(spark, d):
    rows, level, sizes, _ = asked(spark, d)
    near = targets.levels_ahead(rows, level, sizes, F.col("entry"))
    found = rows.join(near, ["symbol", "i"]).select("key", F.posexplode("prices").alias("rank", "target"))
    return found.select("key", (F.col("rank") + 1).cast("long").alias("rank"), "target")


@query("d1_tiered_targets", f"""{REC}{SETUPS}, {sql.DAYS}, sg AS (SELECT key, symbol, confirmation_index AS at_i, confirmation_price AS entry, CASE WHEN direction = 'long' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg, greatest(abs(confirmation_price) * 1e-12::DOUBLE, 1e-12::DOUBLE) AS near FROM su),
lq AS (SELECT key, max(at_i) AS at_i, max(sg.symbol) AS symbol, max(entry) AS entry, max(sg) AS sg, max(near) AS near, list_slice(list_sort(list_distinct(list(sg * pd.price))), 1, 3) AS t FROM sg JOIN pd ON pd.symbol = sg.symbol AND pd.confirmation_index + 1 <= sg.at_i AND sg * pd.price > sg * entry GROUP BY key),
w AS (SELECT sg.key, sg.sg * sw.price AS p FROM sg JOIN sw ON sw.symbol = sg.symbol AND sw.confirmation_index <= sg.at_i AND sw.kind = CASE WHEN sg.sg > 0 THEN 'high' ELSE 'low' END),
one AS (SELECT lq.key, min(w.p) AS p FROM lq JOIN w ON w.key = lq.key AND w.p > lq.t[len(lq.t)] AND w.p - lq.t[len(lq.t)] > lq.near WHERE len(lq.t) < 3 GROUP BY lq.key),
l1 AS (SELECT lq.*, CASE WHEN one.p IS NULL THEN t ELSE list_append(t, one.p) END AS t1 FROM lq LEFT JOIN one ON one.key = lq.key),
two AS (SELECT l1.key, min(w.p) AS p FROM l1 JOIN w ON w.key = l1.key AND w.p > l1.t1[len(l1.t1)] AND w.p - l1.t1[len(l1.t1)] > l1.near WHERE len(l1.t1) < 3 GROUP BY l1.key),
l2 AS (SELECT l1.*, CASE WHEN two.p IS NULL THEN t1 ELSE list_append(t1, two.p) END AS t2 FROM l1 LEFT JOIN two ON two.key = l1.key),
sk AS (SELECT sg.key, sw.kind, sw.price, row_number() OVER (PARTITION BY sg.key ORDER BY sw.confirmation_index, sw.i, sw.kind) AS nth FROM sg JOIN sw ON sw.symbol = sg.symbol AND sw.confirmation_index <= sg.at_i),
sl AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY key ORDER BY nth) = kind THEN 0 ELSE 1 END AS fresh FROM sk),
sr AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY nth) AS run FROM sl),
se AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY CASE WHEN kind = 'high' THEN -price ELSE price END, nth) AS top FROM sr),
en AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run DESC) AS back FROM se WHERE top = 1),
rg AS (SELECT a.key, greatest(a.price, b.price) AS high, least(a.price, b.price) AS low FROM en a JOIN en b ON b.key = a.key WHERE a.back = 1 AND b.back = 2 AND CASE WHEN a.kind = 'high' THEN a.price > b.price ELSE b.price > a.price END),
l3 AS (SELECT l2.*, CASE WHEN sg > 0 THEN rg.high ELSE -rg.low END AS e FROM l2 LEFT JOIN rg ON rg.key = l2.key),
l4 AS (SELECT key, sg, CASE WHEN len(t2) < 3 AND e > t2[len(t2)] AND e - t2[len(t2)] > near THEN list_append(t2, e) ELSE t2 END AS t FROM l3)
SELECT key, rank, sg * t[rank] AS target FROM (SELECT key, sg, t, unnest(range(1, len(t) + 1)) AS rank FROM l4)""")
def d1_tiered(spark, d):
    """Earlier days' extremes, then swings past the last one, then the edge of the newest dealing range."""
    rows, level, sizes, bars = asked(spark, d)
    found = targets.tiered(rows, level, structure.swings(bars), sizes)
    found = rows.join(found, ["symbol", "i", "direction"]).select("key", F.posexplode("targets").alias("rank", "target"))
    return found.select("key", (F.col("rank") + 1).cast("long").alias("rank"), "target")


@query("d2_targets_with_fallback", f"{DAYS_AHEAD}, o AS (SELECT key, min(abs(price - entry)) AS dist FROM lv WHERE abs(price - entry) >= 1.49 * risk GROUP BY key) SELECT su.key, round(confirmation_price + {SG} * coalesce(dist, 2.0 * abs(confirmation_price - stop_price)), 6) AS target FROM su LEFT JOIN o USING (key)")
def d2(spark, d):
    rows, level, sizes, _ = asked(spark, d)
    own, sign = F.abs(F.col("entry") - F.col("stop_price")), risk.side(F.col("direction"))
    near = targets.levels_ahead(rows, level, sizes, targets.past(F.col("entry"), sign, risk.MINIMUM_RR * own), targets.SPARE)
    rows = rows.join(near, ["symbol", "i"], "left")
    far = F.get(F.filter("prices", lambda p: F.abs(p - F.col("entry")) >= risk.MINIMUM_RR * own), F.lit(0))
    return rounded(rows.select("key", F.coalesce(far, F.col("entry") + sign * 2.0 * own).alias("target")), "target")


def live_zones(spark, d, timeframe: str | None = None):
    bars = series(spark, d, [timeframe]) if timeframe else series(spark, d)
    events = structure.breaks(bars, structure.swings(bars))
    return zones.zones(bars, zones.order_blocks(bars, events), zones.gaps(bars))


@query("d3_clean_path", f"{REC}{SETUPS}, {sql.BLOCKS}, {sql.MITIGATION}, {sql.GAPS}, {sql.FILLS}, {sql.ZONES} SELECT key, NOT EXISTS (SELECT 1 FROM z WHERE z.symbol = su.symbol AND z.direction <> CASE WHEN su.direction = 'long' THEN 'bullish' ELSE 'bearish' END AND z.known_at <= confirmation_time_ms AND (z.dead_at IS NULL OR z.dead_at > confirmation_time_ms) AND CASE WHEN su.direction = 'long' THEN z.upper > confirmation_price AND z.lower < target ELSE z.lower < confirmation_price AND z.upper > target END) AS clean_path FROM su")
def d3(spark, d):
    rows, _, sizes, bars = asked(spark, d)
    zone = alive.on_bars(live_zones(spark, d, "15m").drop("timeframe"), bars, ["symbol"])
    zone = zone.select("symbol", F.when(F.col("direction") == "bearish", "long").otherwise("short").alias("direction"), "lower", "upper", "from_i", "until_i")
    low, high = F.least("entry", "target"), F.greatest("entry", "target")
    met = alive.touching(rows.select("key", "symbol", "direction", "i", low.alias("low"), high.alias("high")), zone, ["symbol", "direction"], ("low", "high"), ("lower", "upper"), sizes)
    hit = met.where((F.col("upper") > F.col("low")) & (F.col("lower") < F.col("high"))).select("key", F.lit(False).alias("clean_path")).distinct()
    return rows.select("key").join(hit, "key", "left").select("key", F.coalesce("clean_path", F.lit(True)).alias("clean_path"))


@query("d4_zone_overlap", f"""{WITH}{sql.bars()}, {sql.swings()}, {sql.breaks()}, {sql.BLOCKS}, {sql.MITIGATION}, {sql.GAPS}, {sql.FILLS}, {sql.ZONES} SELECT o.symbol, o.timeframe, o.direction, o.formed AS candle_index, g.formed AS gap_index, greatest(o.lower, g.lower) AS lower, least(o.upper, g.upper) AS upper, greatest(o.known_at, g.known_at) AS from_ms, least(o.dead_at, g.dead_at) AS until_ms
FROM z o JOIN z g ON o.zone_kind = 'OB' AND g.zone_kind = 'FVG' AND g.symbol = o.symbol AND g.timeframe = o.timeframe AND g.direction = o.direction AND o.lower <= g.upper AND g.lower <= o.upper WHERE coalesce(o.dead_at > g.known_at, true) AND coalesce(g.dead_at > o.known_at, true)""")
def d4(spark, d):
    """Order blocks and gaps of one direction that overlap in price while both are live, in any order of forming."""
    found = kept(live_zones(spark, d))
    block = found.where("zone_kind = 'OB'").select(*SERIES, "direction", F.col("formed").alias("candle_index"), "lower", "upper", "known_at", "dead_at")
    gap = found.where("zone_kind = 'FVG'").select(*SERIES, "direction", F.col("formed").alias("gap_index"), F.col("lower").alias("gl"), F.col("upper").alias("gu"), F.col("known_at").alias("gk"), F.col("dead_at").alias("gd"))
    met = overlapping(block, gap, [*SERIES, "direction"], ("lower", "upper"), ("gl", "gu"))
    met = met.where(F.coalesce(F.col("dead_at") > F.col("gk"), F.lit(True)) & F.coalesce(F.col("gd") > F.col("known_at"), F.lit(True)))
    return met.select(*SERIES, "direction", "candle_index", "gap_index", F.greatest("lower", "gl").alias("lower"), F.least("upper", "gu").alias("upper"), F.greatest("known_at", "gk").alias("from_ms"), F.least("dead_at", "gd").alias("until_ms"))


@query("b20_any_bar", f"""{WITH}{sql.bars()}, {sql.swings()}, {sql.breaks()}, {sql.BLOCKS}, {sql.MITIGATION}, {sql.GAPS}, {sql.FILLS}, {sql.ZONES}, {sql.DAYS},
live AS (SELECT b.symbol, b.timeframe, b.i, count(*) FILTER (z.direction = 'bullish') AS n_bullish, count(*) FILTER (z.direction = 'bearish') AS n_bearish, max(z.upper) FILTER (z.direction = 'bullish') AS max_bullish, min(z.lower) FILTER (z.direction = 'bearish') AS min_bearish
      FROM b JOIN z ON z.symbol = b.symbol AND z.timeframe = b.timeframe AND z.known_at <= b.close_time_ms AND (z.dead_at IS NULL OR z.dead_at > b.close_time_ms) GROUP BY b.symbol, b.timeframe, b.i),
brk AS (SELECT b.symbol, b.timeframe, b.i, arg_max(br.direction, br.candle_index) AS direction, arg_max(br.kind, br.candle_index) AS kind FROM b JOIN br ON br.symbol = b.symbol AND br.timeframe = b.timeframe AND br.candle_index <= b.i GROUP BY b.symbol, b.timeframe, b.i),
sc AS (SELECT b.symbol, b.timeframe, b.i, count(*) AS n FROM b JOIN sw ON sw.symbol = b.symbol AND sw.timeframe = b.timeframe AND sw.confirmation_index <= b.i GROUP BY b.symbol, b.timeframe, b.i),
dc AS (SELECT b.symbol, b.timeframe, b.i, count(*) AS n FROM b JOIN pd ON pd.symbol = b.symbol AND pd.timeframe = b.timeframe AND pd.confirmation_index < b.i GROUP BY b.symbol, b.timeframe, b.i)
SELECT b.symbol, b.timeframe, b.i, coalesce(sc.n, 0) AS swings, coalesce(dc.n, 0) AS day_levels, coalesce(n_bullish, 0) AS n_bullish, coalesce(n_bearish, 0) AS n_bearish, max_bullish, min_bearish, brk.kind AS break_kind, brk.direction AS break_direction
FROM b LEFT JOIN live ON live.symbol = b.symbol AND live.timeframe = b.timeframe AND live.i = b.i LEFT JOIN brk ON brk.symbol = b.symbol AND brk.timeframe = b.timeframe AND brk.i = b.i LEFT JOIN sc ON sc.symbol = b.symbol AND sc.timeframe = b.timeframe AND sc.i = b.i LEFT JOIN dc ON dc.symbol = b.symbol AND dc.timeframe = b.timeframe AND dc.i = b.i""")
def b20_any(spark, d):
    rows = snapshot.states(series(spark, d))
    return rows.select(*SERIES, "i", "swings", "day_levels", "n_bullish", "n_bearish", "max_bullish", "min_bearish", F.col("last_break.kind").alias("break_kind"), F.col("last_break.direction").alias("break_direction"))


@query("b20_b21_snapshot")
def b20(spark, d):
    """Every family's state at each series' end, one row a series; a series under 40 bars is warming up."""
    bars = indicators.average_volume(indicators.atr(series(spark, d, ["1h", "4h"])))
    points = structure.swings(bars)
    events = structure.breaks(bars, points)
    zone = zones.zones(bars, zones.order_blocks(bars, events), zones.gaps(bars)).where("dead_at is null")
    pools = liquidity.pools(points, bars).where("superseded_at is null")
    count = lambda df, name: df.groupBy(*SERIES).agg(F.count(F.lit(1)).alias(name))
    end = bars.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("bars"), F.max_by("close", "i").alias("close"), F.max_by("atr", "i").alias("atr"), F.max_by("average_volume", "i").alias("average_volume"))
    end = end.join(events.groupBy(*SERIES).agg(F.max_by(F.struct("kind", "direction", "level"), "candle_index").alias("last_break")), SERIES, "left")
    for name, rows in (("swings", points), ("live_zones", zone), ("pools", pools), ("swept_pools", liquidity.sweeps(bars, pools, ["pool", "version"])), ("intraday_sweeps", liquidity.intraday_sweeps(bars))):
        end = end.join(count(rows, name), SERIES, "left").fillna(0, [name])
    end = end.join(ranges.dealing_ranges(points).select(*SERIES, F.struct("direction", "low", "high", "equilibrium").alias("dealing_range")), SERIES, "left")
    return end.withColumn("premium_discount", ranges.premium_discount(F.col("close"), F.col("dealing_range.equilibrium"))).withColumn("status", F.when(F.col("bars") < scan.HISTORY, "warming_up").otherwise("ready"))


@query("j2_series_analysis")
def j2(spark, d):
    rows = b20(spark, d)
    return rows.select(*SERIES, "status", F.to_json(F.struct("bars", "close", "last_break", "dealing_range", "premium_discount")).alias("payload"))


@query("b10_pool_sweeps")
def b10_sweeps(spark, d):
    bars = series(spark, d, ["1h", "4h"])
    return liquidity.sweeps(bars, pool_versions(bars), ["pool", "version"])

