"""The registered queries over bars made from the event and order-line tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .operators import chunks, crossing, indicators, liquidity, ranges, structure, zones
from .sources import bars as source
from .sources.bars import SERIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LADDER = ["15m", "1h", "4h"]


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str, timeframes: list[str] | None = None) -> DataFrame:
    return structure.indexed(source.bars_of(source.event_ticks(table(spark, sf_dir, "events")), timeframes or LADDER))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.indexed(source.bars_of(source.trade_ticks(table(spark, sf_dir, "lineitem")), ["1d"]))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


OHLC = ("open", "high", "low", "close")
BAR = "symbol, timeframe, open_time_ms, close_time_ms, open, high, low, close, volume"
WITH, REC = "WITH ", "WITH RECURSIVE "


@query("k1_bars", f"{WITH}{sql.bars()} SELECT {BAR} FROM b")
def k1(spark, d):
    return series(spark, d).drop("i")


@query("k1_daily_bars", f"{WITH}{sql.bars(('1d',), sql.TRADES)} SELECT {BAR} FROM b")
def k1_daily(spark, d):
    return daily(spark, d).drop("i")


@query("k2_rollup", f"{WITH}{sql.bars(('1h',))} SELECT symbol, '4h' AS timeframe, open_time_ms // 14400000 * 14400000 AS open_time_ms, open_time_ms // 14400000 * 14400000 + 14399999 AS close_time_ms, arg_min(open, open_time_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time_ms) AS close, sum(volume) AS volume, count(*) AS n FROM b GROUP BY ALL")
def k2(spark, d):
    return source.rolled_up(series(spark, d, ["1h"]), "1h", "4h")


@query("b1_swings", f"{WITH}{sql.bars()}, {sql.swings()} SELECT * FROM sw")
def b1(spark, d):
    return structure.swings(series(spark, d))


@query("b1_swings_wide", f"{WITH}{sql.bars(('1d',), sql.TRADES)}, {sql.swings(3, 3)} SELECT * FROM sw")
def b1_wide(spark, d):
    return structure.swings(daily(spark, d), 3, 3)


BREAKS = f"{sql.bars()}, {sql.swings()}, {sql.breaks()}"


@query("b2_structure_breaks", f"{WITH}{BREAKS} SELECT * FROM br")
def b2(spark, d):
    bars = series(spark, d)
    return structure.breaks(bars, structure.swings(bars))


@query("b3_order_blocks", f"{WITH}{BREAKS}, {sql.BLOCKS} SELECT * FROM ob")
def b3(spark, d):
    bars = series(spark, d)
    return zones.order_blocks(bars, structure.breaks(bars, structure.swings(bars)))


@query("b4_b5_mitigation", f"{WITH}{BREAKS}, {sql.BLOCKS}, {sql.MITIGATION} SELECT * FROM obm")
def b5(spark, d):
    return zones.mitigation(series(spark, d), b3(spark, d))


@query("b6_fair_value_gaps", f"{WITH}{sql.bars()}, {sql.GAPS} SELECT * FROM g")
def b6(spark, d):
    return zones.gaps(series(spark, d))


@query("b7_gap_fills", f"{WITH}{sql.bars()}, {sql.GAPS}, {sql.FILLS} SELECT symbol, timeframe, direction, first_candle_index, confirmation_index, lower, upper, known_at, fully_filled, round(fill_percent, 6) AS fill_percent, fill_index, dead_at FROM gf")
def b7(spark, d):
    bars = series(spark, d)
    return rounded(zones.fills(bars, zones.gaps(bars)), "fill_percent")


@query("b8_average_true_range", f"{REC}{sql.bars()}, {sql.atr()} SELECT symbol, timeframe, i, round(atr, 6) AS atr FROM a")
def b8(spark, d):
    return rounded(indicators.atr(series(spark, d)).select(*SERIES, "i", "atr"), "atr")


@query("b9_average_volume", f"{WITH}{sql.bars()} SELECT symbol, timeframe, i, CASE WHEN i >= 19 THEN round(avg(volume) OVER ({sql.W} ROWS 19 PRECEDING), 6) END AS average_volume FROM b")
def b9(spark, d):
    return rounded(indicators.average_volume(series(spark, d)).select(*SERIES, "i", "average_volume"), "average_volume")


@query("b_chunked_windows", f"""{WITH}{sql.bars()} SELECT symbol, timeframe, i, max(high) OVER ({sql.W} ROWS 9 PRECEDING) AS top_10, min(low) OVER ({sql.W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS low_next_5, max(high) OVER ({sql.W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top_before,
      last_value(CASE WHEN close < open THEN i END IGNORE NULLS) OVER ({sql.W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_down, min(low) OVER ({sql.W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS low_after FROM b""")
def b_chunks(spark, d):
    """Bounded and unbounded windows over chunks of 64 bars, so that series of any table here have many."""
    size = 64
    bars = chunks.numbered(source.bars_of(source.event_ticks(table(spark, d, "events")), LADDER), size)
    near = chunks.with_halo(bars, 9, 5, size)
    near = near.withColumn("top_10", F.max("high").over(chunks.inside().rowsBetween(-9, 0))).withColumn("low_next_5", F.min("low").over(chunks.inside().rowsBetween(1, 5)))
    rows = chunks.so_far(bars, {"top_before": ("max", F.col("high")), "last_down": ("last", F.when(F.col("close") < F.col("open"), F.col("i")))}, size=size)
    rows = chunks.so_far(rows, {"low_after": ("min", F.col("low"))}, ahead=True, size=size)
    return chunks.joined(chunks.own(near).select(*SERIES, "i", "top_10", "low_next_5"), rows.select(*SERIES, "i", "top_before", "last_down", "low_after"), ["i"])


def pool_versions(bars: DataFrame) -> DataFrame:
    return liquidity.pools(structure.swings(bars), indicators.atr(bars))


@query("b10_liquidity_pools")
def b10(spark, d):
    return pool_versions(series(spark, d, ["1h", "4h"]))


@query("b11_liquidity_sweeps", f"""{WITH}{sql.bars()}, {sql.DAYS} SELECT pd.*, s.i AS candle_index, CASE WHEN kind = 'high' THEN 'bearish' ELSE 'bullish' END AS direction FROM pd, LATERAL (SELECT min(x.i) AS i FROM b x WHERE x.symbol = pd.symbol AND x.timeframe = pd.timeframe
      AND x.i > pd.confirmation_index AND x.i <= pd.confirmation_index + 500 AND CASE WHEN kind = 'high' THEN x.high > price AND x.close < price ELSE x.low < price AND x.close > price END) s WHERE s.i IS NOT NULL""")
def b11(spark, d):
    bars = series(spark, d)
    return liquidity.sweeps(bars, liquidity.previous_days(bars).drop("known_at"), ["kind", "confirmation_index"])


@query("b12_previous_day_extremes", f"{WITH}{sql.bars()}, {sql.DAYS} SELECT pd.*, x.close_time_ms AS known_at FROM pd JOIN b x ON x.symbol = pd.symbol AND x.timeframe = pd.timeframe AND x.i = pd.confirmation_index + 1")
def b12(spark, d):
    return liquidity.previous_days(series(spark, d))


@query("b13_current_day_extremes", f"""{WITH}{sql.bars()}, e AS (SELECT symbol, timeframe, max(i) AS n, max(open_time_ms) // 86400000 AS day FROM b GROUP BY ALL), x AS (SELECT b.*, max(high) OVER s AS h, min(low) OVER s AS l, max(i) OVER s AS confirmation_index FROM b JOIN e USING (symbol, timeframe) WHERE i < n AND open_time_ms // 86400000 = day WINDOW s AS (PARTITION BY symbol, timeframe))
SELECT symbol, timeframe, 'high' AS kind, h AS price, list(i ORDER BY i) FILTER (high = h) AS source_indices, confirmation_index FROM x GROUP BY ALL UNION ALL SELECT symbol, timeframe, 'low', l, list(i ORDER BY i) FILTER (low = l), confirmation_index FROM x GROUP BY ALL""")
def b13(spark, d):
    return liquidity.current_day(series(spark, d))


INTRADAY = f"""iw AS (SELECT *, max(high) OVER q AS h, min(low) OVER q AS l FROM b WINDOW q AS (PARTITION BY symbol, timeframe, open_time_ms // 86400000 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
isw AS (SELECT {sql.S}, i AS candle_index, close_time_ms AS known_at, 'bearish' AS direction, h AS level, 'high' AS level_kind FROM iw WHERE high > h AND close < h UNION ALL SELECT {sql.S}, i, close_time_ms, 'bullish', l, 'low' FROM iw WHERE low < l AND close > l)"""


@query("b14_intraday_sweeps", f"{WITH}{sql.bars()}, {INTRADAY} SELECT * FROM isw")
def b14(spark, d):
    return liquidity.intraday_sweeps(series(spark, d))


@query("b15_levels_near_zones", f"""{REC}{sql.bars()}, {sql.atr()}, {sql.DAYS}, {sql.GAPS} SELECT g.symbol, g.timeframe, g.confirmation_index AS zone_index, pd.confirmation_index AS level_index, pd.kind, pd.price
FROM g JOIN a ON a.symbol = g.symbol AND a.timeframe = g.timeframe AND a.i = g.confirmation_index JOIN pd ON pd.symbol = g.symbol AND pd.timeframe = g.timeframe AND pd.confirmation_index <= g.confirmation_index WHERE greatest(lower - price, price - upper, 0) <= atr * 0.5""")
def b15(spark, d):
    """Gaps with all earlier days' extremes in them or within half an average range of them."""
    bars = series(spark, d)
    levels = liquidity.previous_days(bars).select(*SERIES, F.col("confirmation_index").alias("level_index"), "kind", "price")
    found = zones.gaps(bars).join(indicators.atr(bars).select(*SERIES, F.col("i").alias("confirmation_index"), "atr"), [*SERIES, "confirmation_index"]).withColumnRenamed("confirmation_index", "zone_index")
    reach = F.col("atr") * 0.5 * (1 + 1e-9)
    near = crossing.overlapping(found.withColumn("_low", F.col("lower") - reach).withColumn("_high", F.col("upper") + reach), levels, SERIES, ("_low", "_high"), ("price", "price"))
    near = near.where((F.col("level_index") <= F.col("zone_index")) & liquidity.near_zone(F.col("price"), F.col("lower"), F.col("upper"), F.col("atr"), 0.5))
    return near.select(*SERIES, "zone_index", "level_index", "kind", "price")


RANGE = "symbol, timeframe, direction, start_index, end_index, confirmation_index, low, high, round(equilibrium, 6) AS equilibrium, round(ote_lower, 6) AS ote_lower, round(ote_upper, 6) AS ote_upper"
BAND = ("equilibrium", "ote_lower", "ote_upper")


@query("b16_dealing_range", f"{WITH}{sql.bars()}, {sql.swings()}, {sql.LEGS} SELECT {RANGE} FROM bands WHERE fine QUALIFY run = max(run) OVER (PARTITION BY symbol, timeframe)")
def b16(spark, d):
    return rounded(ranges.dealing_ranges(structure.swings(series(spark, d))), *BAND)


@query("b16_directional_range", f"{WITH}{sql.bars()}, {sql.swings()}, {sql.LEGS}, last AS (SELECT * FROM bands WHERE direction = 'bullish' QUALIFY run = max(run) OVER (PARTITION BY symbol, timeframe)) SELECT {RANGE} FROM last WHERE fine")
def b16_up(spark, d):
    return rounded(ranges.dealing_ranges(structure.swings(series(spark, d)), "bullish"), *BAND)


@query("b17_anchored_range", f"""{WITH}{BREAKS}, st AS (SELECT br.symbol, br.timeframe, br.swing_index, br.direction, e.price AS ep, e.confirmation_index AS ec, s.i AS start_index, s.price AS sp, s.confirmation_index AS sc, row_number() OVER (PARTITION BY br.symbol, br.timeframe, br.swing_index, br.direction ORDER BY s.i DESC) AS nth
FROM br JOIN sw e ON e.symbol = br.symbol AND e.timeframe = br.timeframe AND e.i = br.swing_index AND e.kind = CASE WHEN br.direction = 'bullish' THEN 'high' ELSE 'low' END JOIN sw s ON s.symbol = br.symbol AND s.timeframe = br.timeframe AND s.kind <> e.kind AND s.i < e.i),
f AS (SELECT symbol, timeframe, swing_index, direction, start_index, swing_index AS end_index, greatest(ec, sc) AS confirmation_index, least(ep, sp) AS low, greatest(ep, sp) AS high, CASE WHEN direction = 'bullish' THEN ep > sp ELSE sp > ep END AS fine FROM st WHERE nth = 1)
SELECT swing_index, {RANGE} FROM (SELECT *, (low + high) / 2 AS equilibrium, CASE WHEN direction = 'bullish' THEN high - (high - low) * 0.79 ELSE low + (high - low) * 0.62 END AS ote_lower, CASE WHEN direction = 'bullish' THEN high - (high - low) * 0.62 ELSE low + (high - low) * 0.79 END AS ote_upper FROM f) WHERE fine""")
def b17(spark, d):
    bars = series(spark, d)
    points = structure.swings(bars)
    return rounded(ranges.anchored_ranges(points, structure.breaks(bars, points).select(*SERIES, "direction", "swing_index")), *BAND)


@query("b18_premium_discount", f"{WITH}{sql.bars()}, {sql.swings()}, {sql.LEGS}, r AS (SELECT * FROM bands WHERE fine QUALIFY run = max(run) OVER (PARTITION BY symbol, timeframe)) SELECT b.symbol, b.timeframe, CASE WHEN close > equilibrium THEN 'premium' WHEN close < equilibrium THEN 'discount' ELSE 'equilibrium' END AS place FROM b JOIN r USING (symbol, timeframe) QUALIFY b.i = max(b.i) OVER (PARTITION BY b.symbol, b.timeframe)")
def b18(spark, d):
    bars = series(spark, d)
    last = bars.groupBy(*SERIES).agg(F.max_by("close", "i").alias("close"))
    return last.join(ranges.dealing_ranges(structure.swings(bars)), SERIES).select(*SERIES, ranges.premium_discount(F.col("close"), F.col("equilibrium")).alias("place"))


@query("b19_internal_structure", f"{WITH}{sql.bars()}, {sql.swings(1, 1)}, {sql.breaks()} SELECT b.symbol, b.timeframe, b.i, CASE WHEN b.i >= 4 THEN (SELECT arg_max(direction, candle_index) FROM br WHERE br.symbol = b.symbol AND br.timeframe = b.timeframe AND br.candle_index BETWEEN b.i - 2 AND b.i) END AS internal_direction FROM b")
def b19(spark, d):
    return structure.internal_direction(series(spark, d)).select(*SERIES, "i", "internal_direction")


@query("b0_first_crossing", f"{WITH}{sql.bars()} SELECT symbol, timeframe, i, high AS price, (SELECT min(x.i) FROM b x WHERE x.symbol = b.symbol AND x.timeframe = b.timeframe AND x.i >= b.i + 1 AND x.close > b.high) AS crossed FROM b")
def b0(spark, d):
    bars = series(spark, d)
    levels = bars.select(*SERIES, F.col("i").alias("level_index"), (F.col("i") + 1).alias("start"), F.col("high").alias("price"))
    found = crossing.first_crossing(levels, bars, ["level_index"], "start", F.col("close") > F.col("price"), F.col("top_close") > F.col("price"))
    return found.select(*SERIES, F.col("level_index").alias("i"), "price", "crossed")


from . import queries_ops, queries_scan  # noqa: E402,F401  register their queries
