"""Queries for upkeep, risk, setups, lifecycle, sessions and presentation, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sql
from .functions import risk
from .operators import indicators, lifecycle, liquidity, sessions, structure, upkeep, zones
from .operators.crossing import asof
from .queries import BAR, BREAKS, INTRADAY, LADDER, REC, WITH, query, rounded, series, table
from .sources import bars as source
from .sources.bars import SERIES
from .streaming import setups as setup_stream

NUDGED = "CASE WHEN i % 4 = 0 THEN close + 0.5 ELSE close END"


def stored(bars: DataFrame) -> DataFrame:
    return bars.where("i % 10 <> 3").drop("i")


def incoming(bars: DataFrame) -> DataFrame:
    """What a feed sends again: every fourth bar corrected, and some that the store lacks."""
    return bars.where("i % 4 = 0 or i % 10 = 3").withColumn("close", F.when(F.col("i") % 4 == 0, F.col("close") + 0.5).otherwise(F.col("close"))).withColumn("high", F.greatest("high", "close")).drop("i")


STORED = "st AS (SELECT * FROM b WHERE i % 10 <> 3)"
INCOMING = f"inc AS (SELECT * REPLACE (greatest(high, {NUDGED}) AS high, {NUDGED} AS close) FROM b WHERE i % 4 = 0 OR i % 10 = 3)"
MERGED = f"""mg AS (SELECT * EXCLUDE (src) FROM (SELECT *, 0 AS src FROM st UNION ALL SELECT *, 1 FROM inc) QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, open_time_ms ORDER BY src DESC) = 1),
mt AS (SELECT * FROM mg QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY open_time_ms DESC) <= 500)"""


@query("a1_feed_messages", f"""{WITH}{sql.bars(("15m", "1h"))} SELECT CASE WHEN i % 50 = 7 THEN 'invalid' WHEN i % 13 = 5 OR symbol = 'error' THEN 'ignored' WHEN i % 17 = 4 THEN 'invalid' ELSE 'ok' END AS outcome, count(*) AS n,
round(sum(CASE WHEN i % 50 <> 7 AND i % 13 <> 5 AND symbol <> 'error' AND i % 17 <> 4 THEN close END), 4) AS closes FROM b GROUP BY ALL""")
def a1(spark, d):
    bars = source.exact(series(spark, d, ["15m", "1h"]).drop("i"))
    bars = structure.indexed(bars)
    k = F.struct(F.col("symbol").alias("s"), F.col("timeframe").alias("i"), F.col("open_time_ms").alias("t"), F.col("close_time_ms").alias("T"), F.col("open").cast("string").alias("o"), F.when(F.col("i") % 17 == 4, F.lit("-1")).otherwise(F.col("high").cast("string")).alias("h"), F.col("low").cast("string").alias("l"), F.col("close").cast("string").alias("c"), F.col("volume").cast("string").alias("v"), (F.col("i") % 13 != 5).alias("x"))
    message = F.to_json(F.struct(F.lower(F.concat("symbol", F.lit("@kline"))).alias("stream"), F.struct(F.lit("kline").alias("e"), k.alias("k")).alias("data")))
    lines = bars.select(F.when(F.col("i") % 50 == 7, F.lit("{broken")).otherwise(message).alias("value"))
    out = source.feed_messages(lines, ["click", "purchase", "signup", "view"], LADDER)
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(F.col("outcome") == "ok", F.col("bar.close").cast("double"))), 4).alias("closes"))


@query("a2_history_rows", f"{WITH}{sql.bars(('1h',))}, n AS (SELECT max(close_time_ms) - 36000000 AS t FROM b) SELECT symbol, timeframe, open_time_ms, close_time_ms, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM b, n WHERE close_time_ms < t")
def a2(spark, d):
    bars = source.exact(series(spark, d, ["1h"]).drop("i"))
    row = F.array(*[F.col(c).cast("string") for c in ("open_time_ms", "open", "high", "low", "close", "volume", "close_time_ms")])
    answers = bars.groupBy("symbol", "timeframe", F.floor(F.col("open_time_ms") / 86_400_000)).agg(F.to_json(F.collect_list(row)).alias("value")).select("symbol", "timeframe", "value")
    now = bars.agg((F.max("close_time_ms") - 36_000_000).alias("now"))
    rows = source.history_rows(answers.join(F.broadcast(now)), F.col("now"))
    return rows.select("symbol", "timeframe", "open_time_ms", "close_time_ms", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("open", "high", "low", "close", "volume")])


@query("a3_instruments", "SELECT 'P' || p_partkey AS symbol, round((p_size % 4) * 0.01, 2)::DOUBLE AS tick_size FROM part WHERE p_size % 5 <> 0 AND p_size % 4 > 0")
def a3(spark, d):
    part = table(spark, d, "part")
    price = F.struct(F.lit("PRICE_FILTER").alias("filterType"), F.format_number((F.col("p_size") % 4) * 0.01, 2).alias("tickSize"))
    one = F.struct(F.concat(F.lit("P"), "p_partkey").alias("symbol"), F.when(F.col("p_size") % 5 == 0, "BREAK").otherwise("TRADING").alias("status"), F.array(F.struct(F.lit("LOT_SIZE").alias("filterType"), F.lit("1").alias("tickSize")), price).alias("filters"))
    return source.instrument_filters(part.select(F.to_json(F.struct(F.array(one).alias("symbols"))).alias("value"))).withColumn("tick_size", F.col("tick_size").cast("double"))


@query("a4_history_load", f"{WITH}{sql.bars()}, {STORED}, {INCOMING}, {MERGED} SELECT {BAR} FROM mt")
def a4(spark, d):
    bars = series(spark, d)
    return upkeep.merged(stored(bars), incoming(bars))


@query("a5_upsert_retention", f"""{WITH}{sql.bars()}, u AS (SELECT *, 0 AS seq FROM b UNION ALL SELECT * REPLACE (close + 1 AS close), 1 FROM b WHERE i % 3 = 0), l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, open_time_ms ORDER BY seq DESC) = 1)
SELECT {BAR} FROM l QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY open_time_ms DESC) <= 500""")
def a5(spark, d):
    bars = series(spark, d)
    writes = bars.withColumn("seq", F.lit(0)).unionByName(bars.where("i % 3 = 0").withColumn("close", F.col("close") + 1).withColumn("seq", F.lit(1)))
    return upkeep.upserted(writes.drop("i"), "seq")


@query("a6_window_read", f"{WITH}{sql.bars()} SELECT {BAR} FROM b QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY open_time_ms DESC) <= 500")
def a6(spark, d):
    return upkeep.newest(series(spark, d).drop("i"))


ARRIVAL = "open_time_ms + (i * 7 % 5) * 1800000"


@query("a7_append_only", f"{WITH}{sql.bars()} SELECT symbol, timeframe, open_time_ms FROM (SELECT *, max(open_time_ms) OVER (PARTITION BY symbol, timeframe ORDER BY {ARRIVAL}, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b) WHERE m IS NULL OR open_time_ms > m")
def a7(spark, d):
    return upkeep.accepted(series(spark, d).withColumn("arrival", F.expr(ARRIVAL)), ["arrival", "i"]).select(*SERIES, "open_time_ms")


HOLES = "ho AS (SELECT symbol, timeframe, open_time_ms, lag(open_time_ms) OVER (PARTITION BY symbol, timeframe ORDER BY open_time_ms) AS previous_open_ms, length FROM st JOIN tf USING (timeframe)), ga AS (SELECT symbol, timeframe, open_time_ms, previous_open_ms, (open_time_ms - previous_open_ms) // length - 1 AS missing_bars FROM ho WHERE open_time_ms > previous_open_ms + length)"


@query("a8_gaps", f"{WITH}{sql.bars()}, {STORED}, {HOLES} SELECT * FROM ga")
def a8(spark, d):
    return upkeep.gaps(stored(series(spark, d)))


@query("a9_gap_recovery", f"{WITH}{sql.bars()}, st AS (SELECT * FROM b WHERE i % 10 <> 3 AND i < 300 AND symbol <> 'view'), {INCOMING}, {MERGED}, la AS (SELECT symbol, timeframe, max(open_time_ms) AS latest FROM st GROUP BY ALL) SELECT {BAR}, CASE WHEN latest IS NULL THEN open_time_ms = max(open_time_ms) OVER (PARTITION BY symbol, timeframe) ELSE open_time_ms > latest END AS emitted FROM mt LEFT JOIN la USING (symbol, timeframe)")
def a9(spark, d):
    bars = series(spark, d)
    return upkeep.reconciled(stored(bars.where("i < 300 and symbol <> 'view'")), incoming(bars))


@query("a10_reconcile_report", f"""{WITH}{sql.bars()}, {STORED}, au AS (SELECT * REPLACE ({NUDGED} AS close) FROM b WHERE i % 9 <> 2), j AS (SELECT coalesce(st.symbol, au.symbol) AS symbol, coalesce(st.timeframe, au.timeframe) AS timeframe, st.close AS s, au.close AS a FROM st FULL JOIN au ON st.symbol = au.symbol AND st.timeframe = au.timeframe AND st.open_time_ms = au.open_time_ms)
SELECT symbol, timeframe, count(a) AS checked, count(*) FILTER (s IS NOT NULL AND a IS NOT NULL AND s <> a) AS changed, count(*) FILTER (s IS NULL) AS missing, count(*) FILTER (a IS NULL) AS extra, count(*) FILTER (s IS NOT NULL AND a IS NOT NULL AND s <> a) = 0 AND count(*) FILTER (s IS NULL) = 0 AS complete FROM j GROUP BY symbol, timeframe""")
def a10(spark, d):
    bars = series(spark, d)
    truth = bars.where("i % 9 <> 2").withColumn("close", F.when(F.col("i") % 4 == 0, F.col("close") + 0.5).otherwise(F.col("close"))).drop("i")
    return upkeep.differences(stored(bars), truth)


FRESH = """now AS (SELECT max(close_time_ms) + 600000 AS t FROM b), grid AS (SELECT * FROM (SELECT DISTINCT event_type AS symbol FROM events), (VALUES ('15m', 900000), ('1h', 3600000), ('4h', 14400000)) v(timeframe, len)), hv AS (SELECT symbol, timeframe, count(*) AS n, max(close_time_ms) AS c FROM b WHERE symbol <> 'view' OR timeframe <> '4h' GROUP BY ALL),
fr AS (SELECT grid.symbol, grid.timeframe, coalesce(n, 0) AS bars, t - c AS age_ms, c IS NULL AS missing, coalesce(n, 0) > 0 AND n < 500 AS underfilled, coalesce(t - c > len + 120000, false) AS stale FROM grid CROSS JOIN now LEFT JOIN hv USING (symbol, timeframe))"""


def fresh(spark, d) -> DataFrame:
    bars = series(spark, d)
    now = bars.agg((F.max("close_time_ms") + 600_000).alias("now"))
    have = bars.where("symbol <> 'view' or timeframe <> '4h'")
    symbols = table(spark, d, "events").select(F.col("event_type").alias("symbol")).distinct().join(F.broadcast(now))
    grid = upkeep.freshness(have, symbols, LADDER, F.lit(0))
    return grid.join(F.broadcast(now)).withColumn("age_ms", F.col("now") + F.col("age_ms")).withColumn("stale", F.coalesce(F.col("age_ms") > upkeep.interval() + 120_000, F.lit(False))).drop("now")


@query("a11_freshness", f"{WITH}{sql.bars()}, {FRESH} SELECT * FROM fr")
def a11(spark, d):
    return fresh(spark, d)


@query("a11_freshness_status", f"{WITH}{sql.bars()}, {FRESH} SELECT count(*) AS series, count(*) FILTER (missing) AS missing, count(*) FILTER (underfilled) AS underfilled, count(*) FILTER (stale) AS stale, max(age_ms) AS max_age_ms, CASE WHEN count(*) FILTER (missing OR underfilled OR stale) = 0 THEN 'ok' ELSE 'degraded' END AS status FROM fr")
def a11_status(spark, d):
    return upkeep.freshness_status(fresh(spark, d))


@query("a12_bar_validation", f"{WITH}{sql.bars()} SELECT symbol, timeframe, CASE WHEN i % 11 = 3 THEN 'inconsistent' WHEN i % 13 = 3 THEN 'values_missing' ELSE 'fine' END AS problem, count(*) AS n FROM b GROUP BY ALL")
def a12(spark, d):
    bars = series(spark, d)
    bars = bars.withColumn("low", F.when(F.col("i") % 11 == 3, F.col("high") + 1).otherwise(F.col("low"))).withColumn("volume", F.when((F.col("i") % 13 == 3) & (F.col("i") % 11 != 3), F.lit(float("nan"))).otherwise(F.col("volume")))
    return upkeep.checked(bars).groupBy(*SERIES, F.coalesce("problem", F.lit("fine")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query("a13_status", f"{WITH}{sql.bars()} SELECT timeframe, count(DISTINCT symbol) AS series, count(*) AS bars, max(close_time_ms) AS last_close_ms FROM b GROUP BY ALL")
def a13(spark, d):
    return series(spark, d).groupBy("timeframe").agg(F.count_distinct("symbol").alias("series"), F.count(F.lit(1)).alias("bars"), F.max("close_time_ms").alias("last_close_ms"))


@query("a14_store_audit", f"""{WITH}{sql.bars()}, {STORED}, {HOLES}, du AS (SELECT symbol, timeframe, count(*) AS dups FROM b WHERE i % 10 = 4 GROUP BY ALL), n AS (SELECT symbol, timeframe, count(*) AS n FROM st GROUP BY ALL), h AS (SELECT symbol, timeframe, count(*) AS gaps FROM ga GROUP BY ALL)
SELECT symbol, timeframe, n + dups AS bars, dups AS duplicates, coalesce(gaps, 0) AS gaps, n + dups = 500 AND dups = 0 AND coalesce(gaps, 0) = 0 AS exact FROM n JOIN du USING (symbol, timeframe) LEFT JOIN h USING (symbol, timeframe)""")
def a14(spark, d):
    bars = series(spark, d)
    return upkeep.audited(stored(bars).unionByName(bars.where("i % 10 = 4").drop("i")))


@query("a15_event_history", f"{WITH}{BREAKS} SELECT symbol, timeframe, candle_index, known_at FROM br ORDER BY known_at DESC, symbol, timeframe, candle_index LIMIT 200")
def a15(spark, d):
    bars = series(spark, d)
    events = structure.breaks(bars, structure.swings(bars))
    kept = events.orderBy(F.desc("known_at"), "symbol", "timeframe", "candle_index").limit(200)
    sent = kept.select(F.to_json(F.struct("symbol", "timeframe", "candle_index", "known_at")).alias("value"))
    return sent.select(F.from_json("value", "symbol string, timeframe string, candle_index int, known_at bigint").alias("x")).select("x.*")


@query("a16_snapshot_slice", f"{WITH}{sql.bars()}, t AS (SELECT symbol, max(close_time_ms) AS t FROM b WHERE timeframe = '15m' AND i % 100 = 50 GROUP BY ALL) SELECT symbol, timeframe, count(*) AS bars, max(close_time_ms) AS last_close_ms FROM b JOIN t USING (symbol) WHERE close_time_ms <= t GROUP BY symbol, timeframe")
def a16(spark, d):
    bars = series(spark, d)
    snapshot = bars.where("timeframe = '15m' and i % 100 = 50").groupBy("symbol").agg(F.max("close_time_ms").alias("t"))
    return upkeep.until(bars.join(snapshot, "symbol"), F.col("t")).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("bars"), F.max("close_time_ms").alias("last_close_ms"))


#: Setups that the later queries take: every structure break on 15-minute bars, its stop one average range away.
SETUPS = f"""{sql.bars(('15m',))}, {sql.swings()}, {sql.breaks()}, {sql.atr()},
su AS (SELECT br.symbol || ':' || br.candle_index AS key, br.symbol, br.timeframe, CASE WHEN br.candle_index % 2 = 0 THEN 'scalp' ELSE 'intraday' END AS profile, CASE WHEN direction = 'bullish' THEN 'long' ELSE 'short' END AS direction, br.candle_index AS confirmation_index, br.known_at AS confirmation_time_ms,
      a.close AS confirmation_price, CASE WHEN direction = 'bullish' THEN a.close - a.atr ELSE a.close + a.atr END AS stop_price, CASE WHEN direction = 'bullish' THEN a.close + a.atr * (1.0::DOUBLE + br.candle_index % 3 * 0.6::DOUBLE) ELSE a.close - a.atr * (1.0::DOUBLE + br.candle_index % 3 * 0.6::DOUBLE) END AS target, a.atr, br.kind AS source_kind, floor(br.level / 20)::BIGINT AS zone
      FROM br JOIN a ON a.symbol = br.symbol AND a.timeframe = br.timeframe AND a.i = br.candle_index WHERE a.atr > 0)"""


def setups(spark, d) -> DataFrame:
    bars = series(spark, d, ["15m"])
    events = structure.breaks(bars, structure.swings(bars)).withColumnRenamed("candle_index", "i")
    rows = events.join(indicators.atr(bars).select(*SERIES, "i", "close", "atr"), [*SERIES, "i"]).where("atr > 0")
    long = F.col("direction") == "bullish"
    sign = F.when(long, 1.0).otherwise(-1.0)
    return rows.select(F.concat_ws(":", "symbol", "i").alias("key"), *SERIES, F.when(F.col("i") % 2 == 0, "scalp").otherwise("intraday").alias("profile"), F.when(long, "long").otherwise("short").alias("direction"), F.col("i").alias("confirmation_index"), F.col("known_at").alias("confirmation_time_ms"), F.col("close").alias("confirmation_price"), (F.col("close") - sign * F.col("atr")).alias("stop_price"), (F.col("close") + sign * F.col("atr") * (1.0 + F.col("i") % 3 * 0.6)).alias("target"), "atr", F.col("kind").alias("source_kind"), F.floor(F.col("level") / 20).alias("zone"))


SG = "CASE WHEN direction = 'long' THEN 1 ELSE -1 END"
RR = "abs(target - confirmation_price) / abs(confirmation_price - stop_price)"


@query("c1_c3_risk_reward", f"{REC}{SETUPS} SELECT key, round({RR}, 6) AS risk_reward, {RR} >= 1.49 AS enough FROM su")
def c1(spark, d):
    rr = risk.risk_reward(F.col("direction"), F.col("confirmation_price"), F.col("stop_price"), F.col("target"))
    return setups(spark, d).select("key", F.round(rr, 6).alias("risk_reward"), (F.coalesce(rr, F.lit(0.0)) >= risk.MINIMUM_RR).alias("enough"))


@query("c2_entry_limit", f"""{REC}{SETUPS}, r AS (SELECT *, (target::DECIMAL(20,10)::DOUBLE + 1.5 * stop_price::DECIMAL(20,10)::DOUBLE) / 2.5 AS raw FROM su), l AS (SELECT *, CASE WHEN direction = 'long' THEN floor(round(raw / 0.05, 7)) ELSE ceil(round(raw / 0.05, 7)) END * 0.05 AS lim FROM r)
SELECT key, CASE WHEN lim > least(stop_price, target) AND lim < greatest(stop_price, target) THEN round(lim, 4) END AS entry_limit FROM l""")
def c2(spark, d):
    return rounded(setups(spark, d).select("key", risk.entry_limit(F.col("direction"), F.col("target"), F.col("stop_price"), F.lit(0.05)).alias("entry_limit")), "entry_limit", digits=4)


@query("c4_c6_stops_and_costs", f"""{REC}{SETUPS} SELECT key, round(confirmation_price - {SG} * 0.3 * atr, 6) AS stop, round(0.0005 * (confirmation_price + target) / abs(confirmation_price - stop_price), 6) AS commission_r, round(greatest(0.5 * atr, 0.002 * confirmation_price), 6) AS minimum_stop FROM su""")
def c4(spark, d):
    rows = setups(spark, d)
    stop = risk.atr_stop(F.col("direction"), F.col("confirmation_price"), risk.stop_buffer(F.col("symbol"), F.lit(0.3)), F.col("atr"))
    return rounded(rows.select("key", stop.alias("stop"), risk.commission(F.col("confirmation_price"), F.col("target"), F.col("stop_price")).alias("commission_r"), risk.minimum_stop(F.col("atr"), F.col("confirmation_price")).alias("minimum_stop")), "stop", "commission_r", "minimum_stop")


EVIDENCE = "confirmation_index % 2 = 0 AS sweep, confirmation_index % 3 = 0 AS overlap, confirmation_index % 5 < 3 AS ote, source_kind = 'BOS' AS bias, confirmation_index % 7 < 4 AS agree, confirmation_index % 4 < 2 AS clean"


def evidence(rows: DataFrame) -> DataFrame:
    at = F.col("confirmation_index")
    fields = {"liquidity_sweep": at % 2 == 0, "order_block_fvg_overlap": at % 3 == 0, "ote_overlap": at % 5 < 3, "higher_timeframe_bias_aligned": F.col("source_kind") == "BOS", "higher_timeframe_agreement": at % 7 < 4, "confirmation_volume": F.col("atr") * 2, "average_volume": F.lit(100.0), "clean_path_to_tp1": at % 4 < 2}
    return rows.withColumn("evidence", F.struct(*[c.alias(n) for n, c in fields.items()]))


POINTS = "CASE WHEN sweep THEN 2 ELSE 0 END + CASE WHEN overlap THEN 2 ELSE 0 END + ote::INTEGER + CASE WHEN bias THEN 2 ELSE 0 END + agree::INTEGER + (atr * 2 > 150)::INTEGER + clean::INTEGER"


@query("g1_score", f"{REC}{SETUPS}, ev AS (SELECT *, {EVIDENCE} FROM su) SELECT key, {POINTS} AS score FROM ev")
def g1(spark, d):
    return evidence(setups(spark, d)).select("key", risk.total(risk.score("evidence")).alias("score"))


@query("g2_eligibility", f"""{REC}{SETUPS}, ev AS (SELECT *, {EVIDENCE}, {RR} AS rr FROM su), lim AS (SELECT *, {POINTS} AS pts, (target::DECIMAL(20,10)::DOUBLE + 1.49 * stop_price::DECIMAL(20,10)::DOUBLE) / 2.49 AS raw FROM ev), li AS (SELECT *, CASE WHEN direction = 'long' THEN floor(round(raw / 0.05, 7)) ELSE ceil(round(raw / 0.05, 7)) END * 0.05 AS cap FROM lim),
lj AS (SELECT *, CASE WHEN cap > least(stop_price, target) AND cap < greatest(stop_price, target) THEN cap END AS entry_limit, confirmation_price + {SG} * atr * 0.1 AS current FROM li),
rs AS (SELECT *, list_filter([CASE WHEN NOT ote THEN 'zone_does_not_intersect_ote' END, CASE WHEN NOT sweep THEN 'liquidity_sweep_missing' END, CASE WHEN pts < 6 THEN 'score_below_threshold' END, CASE WHEN entry_limit IS NULL THEN 'invalid_price_or_risk_parameters' END, CASE WHEN entry_limit IS NOT NULL AND rr < 1.49 THEN 'risk_reward_below_minimum' END, CASE WHEN {SG} * (current - entry_limit) > 0 THEN 'price_beyond_acceptable_entry' END], lambda x: x IS NOT NULL) AS reasons FROM lj)
SELECT key, CASE WHEN len(reasons) = 0 THEN 'ELIGIBLE' WHEN reasons = ['price_beyond_acceptable_entry'] THEN 'MISSED_PRICE' ELSE 'REJECTED' END AS status, array_to_string(reasons, ',') AS reasons FROM rs""")
def g2(spark, d):
    from .plans import decide

    rows = evidence(setups(spark, d)).withColumn("current_price", F.col("confirmation_price") + risk.side(F.col("direction")) * F.col("atr") * 0.1)
    rows = rows.withColumn("zone_intersects_ote", F.col("evidence.ote_overlap"))
    return decide.eligibility(rows, F.lit(0.05)).select("key", "status", F.array_join("reasons", ",").alias("reasons"))


OUT = f"""life AS (SELECT su.*, CASE WHEN profile = 'scalp' THEN 3 ELSE 12 END * 3600000 AS life FROM su),
hits AS (SELECT key, (SELECT min(x.i) FROM b x WHERE x.symbol = l.symbol AND x.i > l.confirmation_index AND CASE WHEN direction = 'long' THEN x.low <= stop_price ELSE x.high >= stop_price END) AS sl, (SELECT min(x.i) FROM b x WHERE x.symbol = l.symbol AND x.i > l.confirmation_index AND CASE WHEN direction = 'long' THEN x.high >= target ELSE x.low <= target END) AS tp,
      (SELECT min(x.i) FROM b x WHERE x.symbol = l.symbol AND x.i > l.confirmation_index AND x.close_time_ms >= confirmation_time_ms + life) AS ex FROM life l),
fin AS (SELECT su.*, least(coalesce(sl, 1e9), coalesce(tp, 1e9), coalesce(ex, 1e9))::BIGINT AS at_i, sl, tp, ex FROM su JOIN hits USING (key)),
oc AS (SELECT fin.*, b.close_time_ms AS closed_at_ms, CASE WHEN b.i IS NULL THEN NULL WHEN sl = at_i THEN 'SL' WHEN tp = at_i THEN 'TP1' ELSE 'EXPIRED' END AS final_status, CASE WHEN sl = at_i THEN stop_price WHEN tp = at_i THEN target ELSE b.close END AS leave FROM fin LEFT JOIN b ON b.symbol = fin.symbol AND b.i = at_i),
oo AS (SELECT *, CASE WHEN final_status = 'SL' THEN -1.0::DOUBLE WHEN final_status IS NOT NULL THEN {SG} * (leave - confirmation_price) / abs(confirmation_price - stop_price) END AS gross_r, CASE WHEN final_status IS NOT NULL THEN 0.0005 * (confirmation_price + leave) / abs(confirmation_price - stop_price) END AS commission_r FROM oc),
ou AS (SELECT *, gross_r - commission_r AS net_r FROM oo)"""


def closed(spark, d) -> DataFrame:
    return lifecycle.outcomes(setups(spark, d), series(spark, d, ["15m"]))


@query("h3_outcomes", f"{REC}{SETUPS}, {OUT} SELECT key, final_status, closed_at_ms, round(gross_r, 6) AS gross_r, round(commission_r, 6) AS commission_r, round(net_r, 6) AS net_r FROM ou")
def h3(spark, d):
    return rounded(closed(spark, d).select("key", "final_status", "closed_at_ms", "gross_r", "commission_r", "net_r"), "gross_r", "commission_r", "net_r")


#: Every status a decision can have, by the confirmation's index.
DECIDED = "CASE WHEN confirmation_index % 11 = 5 THEN 'REJECTED' WHEN confirmation_index % 7 = 4 THEN 'MISSED_PRICE' WHEN confirmation_index % 5 = 3 THEN 'CANDIDATE' ELSE 'ACCEPTED' END"


#: A third of the setups recur half an hour later under their key, most with another status.
AGAIN = DECIDED.replace("confirmation_index", "(confirmation_index + 4)")


@query("h2_acceptance", f"""{REC}{SETUPS}, {OUT}, d1 AS (SELECT key, symbol, profile, zone, confirmation_index, confirmation_time_ms AS t, coalesce(closed_at_ms, 4611686018427387904) AS ends, CASE WHEN profile = 'scalp' THEN 30 ELSE 120 END * 60000 AS pause, {RR} AS rr, {DECIDED} AS status FROM ou),
dc AS (SELECT * FROM d1 UNION ALL SELECT key, symbol, profile, zone, confirmation_index, t + 1800000, ends, pause, rr, {AGAIN} FROM d1 WHERE confirmation_index % 3 = 0),
sr AS (SELECT *, row_number() OVER (PARTITION BY symbol, profile ORDER BY t, key) AS n FROM dc WHERE status = 'MISSED_PRICE' OR (status <> 'REJECTED' AND rr >= 1.49)),
st AS (SELECT DISTINCT symbol, profile, 0::BIGINT AS n, NULL::VARCHAR AS key, 0::BIGINT AS t, NULL::VARCHAR AS status, 0::BIGINT AS busy_until, []::STRUCT(zone BIGINT, t BIGINT)[] AS begun, []::VARCHAR[] AS known, false AS again, false AS blocked, false AS paused FROM sr
  UNION ALL SELECT symbol, profile, n, key, t, status, CASE WHEN status = 'ACCEPTED' AND NOT again AND NOT blocked AND NOT paused THEN ends ELSE busy_until END, CASE WHEN status <> 'MISSED_PRICE' AND NOT again AND NOT blocked AND NOT paused THEN list_append(begun, {{'zone': zone, 't': t}}) ELSE begun END,
      CASE WHEN NOT again AND NOT blocked AND NOT paused THEN list_append(known, key) ELSE known END, again, blocked, paused
  FROM (SELECT sr.symbol, sr.profile, sr.n, sr.key, sr.status, sr.ends, sr.zone, sr.t, st.busy_until, st.known, list_contains(st.known, sr.key) AS again, list_filter(st.begun, lambda x: x.t >= sr.t - sr.pause) AS begun, sr.status = 'ACCEPTED' AND sr.t < st.busy_until AS blocked, sr.status <> 'MISSED_PRICE' AND len(list_filter(st.begun, lambda x: x.zone = sr.zone AND x.t >= sr.t - sr.pause)) > 0 AS paused FROM st JOIN sr ON sr.symbol = st.symbol AND sr.profile = st.profile AND sr.n = st.n + 1))
SELECT dc.key, dc.t AS confirmation_time_ms, coalesce(dc.status = 'ACCEPTED' AND NOT again AND NOT blocked AND NOT paused, false) AS accepted, coalesce(NOT again AND NOT blocked AND NOT paused, false) AS stored, coalesce(again, false) AS ignored,
      CASE WHEN dc.status IN ('ACCEPTED', 'CANDIDATE') AND rr < 1.49 THEN 'rr_below_minimum' WHEN coalesce(again, false) THEN '' ELSE concat_ws(',', CASE WHEN blocked THEN 'active_setup_for_symbol_profile' END, CASE WHEN paused THEN 'cooldown_active' END) END AS reasons FROM dc LEFT JOIN st ON st.key = dc.key AND st.t = dc.t""")
def h2(spark, d):
    rr = risk.risk_reward(F.col("direction"), F.col("confirmation_price"), F.col("stop_price"), F.col("target"))
    rows = closed(spark, d).withColumn("zone_key", F.concat_ws(":", "symbol", "profile", "zone")).withColumn("risk_reward", rr).withColumn("status", F.expr(DECIDED))
    later = rows.where("confirmation_index % 3 = 0").withColumn("confirmation_time_ms", F.col("confirmation_time_ms") + 1_800_000).withColumn("status", F.expr(AGAIN))
    return lifecycle.accepted(rows.unionByName(later)).select("key", "confirmation_time_ms", "accepted", "stored", "ignored", F.array_join("gate_reasons", ",").alias("reasons"))


#: Every decision of a stream and the end of every accepted setup, as a fold over symbol and profile.
STREAMED = f"""{OUT}, dc AS (SELECT key, symbol, profile, zone, confirmation_time_ms AS t, coalesce(closed_at_ms, 4611686018427387904) AS ends, CASE WHEN profile = 'scalp' THEN 30 ELSE 120 END * 60000 AS pause, {RR} AS rr, {DECIDED} AS status, final_status, closed_at_ms, net_r FROM ou),
sr AS (SELECT *, row_number() OVER (PARTITION BY symbol, profile ORDER BY t, key) AS n FROM dc WHERE status = 'MISSED_PRICE' OR (status <> 'REJECTED' AND rr >= 1.49)),
st AS (SELECT DISTINCT symbol, profile, 0::BIGINT AS n, NULL::VARCHAR AS key, 0::BIGINT AS busy_until, []::STRUCT(zone BIGINT, t BIGINT)[] AS begun, false AS blocked, false AS paused FROM sr
  UNION ALL SELECT symbol, profile, n, key, CASE WHEN status = 'ACCEPTED' AND NOT blocked AND NOT paused THEN ends ELSE busy_until END, CASE WHEN status <> 'MISSED_PRICE' AND NOT blocked AND NOT paused THEN list_append(begun, {{'zone': zone, 't': t}}) ELSE begun END, blocked, paused
  FROM (SELECT sr.symbol, sr.profile, sr.n, sr.key, sr.status, sr.ends, sr.zone, sr.t, st.busy_until, list_filter(st.begun, lambda x: x.t >= sr.t - sr.pause) AS begun, sr.status = 'ACCEPTED' AND sr.t < st.busy_until AS blocked, sr.status <> 'MISSED_PRICE' AND len(list_filter(st.begun, lambda x: x.zone = sr.zone AND x.t >= sr.t - sr.pause)) > 0 AS paused FROM st JOIN sr ON sr.symbol = st.symbol AND sr.profile = st.profile AND sr.n = st.n + 1)),
dd AS (SELECT dc.*, coalesce(NOT blocked AND NOT paused, false) AS stored, CASE WHEN dc.status IN ('ACCEPTED', 'CANDIDATE') AND rr < 1.49 THEN 'rr_below_minimum' ELSE concat_ws(',', CASE WHEN blocked THEN 'active_setup_for_symbol_profile' END, CASE WHEN paused THEN 'cooldown_active' END) END AS reasons FROM dc LEFT JOIN st USING (key)),
lg AS (SELECT symbol, profile, key, 0 AS seq, t AS event_time_ms, CASE WHEN stored THEN status ELSE 'REJECTED' END AS status, stored, reasons, NULL::DOUBLE AS net_r FROM dd UNION ALL SELECT symbol, profile, key, 1, closed_at_ms, final_status, true, '', round(net_r, 6) FROM dd WHERE stored AND status = 'ACCEPTED' AND final_status IS NOT NULL)"""


def streamed(spark, d) -> DataFrame:
    rr = risk.risk_reward(F.col("direction"), F.col("confirmation_price"), F.col("stop_price"), F.col("target"))
    rows = setups(spark, d).withColumn("zone_key", F.col("zone").cast("string")).withColumn("risk_reward", rr).withColumn("status", F.expr(DECIDED))
    return setup_stream.replayed(rows, series(spark, d, ["15m"]))


@query("h2_h3_stream_events", f"{REC}{SETUPS}, {STREAMED} SELECT key, seq, event_time_ms, status, stored, reasons, net_r FROM lg")
def h2_stream(spark, d):
    return rounded(streamed(spark, d).select("key", "seq", "event_time_ms", "status", "stored", F.array_join("reasons", ",").alias("reasons"), "net_r"), "net_r")


@query("h1_h10_setup_store", f"{REC}{SETUPS}, {STREAMED}, cut AS (SELECT max(event_time_ms) - 86400000 AS c FROM lg) SELECT symbol, profile, count(DISTINCT key) FILTER (stored) AS setups, count(*) FILTER (seq = 1) AS closed, count(DISTINCT key) FILTER (stored AND status = 'ACCEPTED') - count(*) FILTER (seq = 1) AS open_setups, count(*) FILTER (stored OR event_time_ms >= c) AS events_after_purge FROM lg, cut GROUP BY symbol, profile")
def h1_store(spark, d):
    log = streamed(spark, d)
    by = ["symbol", "profile"]
    cut = log.agg(F.max("event_time_ms")).first()[0] or 0
    state = setup_stream.stored_setups(log).groupBy(*by).agg(F.count(F.lit(1)).alias("setups"), F.count(F.when(F.col("status") == "ACCEPTED", 1)).alias("open_setups"))
    closed = setup_stream.stored_journal(log).groupBy(*by).agg(F.count(F.lit(1)).alias("closed"))
    left = setup_stream.purged(log, cut - 86_400_000).groupBy(*by).agg(F.count(F.lit(1)).alias("events_after_purge"))
    groups = log.select(*by).distinct().join(state, by, "left").join(closed, by, "left").join(left, by, "left")
    return groups.select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("setups", "closed", "open_setups", "events_after_purge")])


@query("h4_partial_exits")
def h4(spark, d):
    rows = setups(spark, d).withColumn("targets", F.transform(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), lambda k: F.col("confirmation_price") + risk.side(F.col("direction")) * k * F.col("atr")))
    return rounded(lifecycle.partial_exits(rows, series(spark, d, ["15m"])).select("key", "gross_r"), "gross_r")


@query("h5_choch_invalidation", f"""{REC}{SETUPS}, x AS (SELECT su.key, min(br.known_at) AS invalidated_at_ms FROM su JOIN br ON br.symbol = su.symbol AND br.known_at > su.confirmation_time_ms AND br.candle_index >= 39 AND br.kind = 'CHoCH' AND br.direction = CASE WHEN su.direction = 'long' THEN 'bearish' ELSE 'bullish' END GROUP BY su.key) SELECT key, invalidated_at_ms FROM su LEFT JOIN x USING (key)""")
def h5(spark, d):
    bars = series(spark, d, ["15m"])
    events = structure.breaks(bars, structure.swings(bars)).where("kind = 'CHoCH' and candle_index >= 39")
    # the next opposite event: from the end of time backwards an as-of join
    against = F.when(F.col("direction") == "bullish", "short").otherwise("long")
    later = events.select(*SERIES, against.alias("direction"), (-F.col("known_at")).alias("back"), "known_at")
    rows = setups(spark, d).withColumn("back", -F.col("confirmation_time_ms") - 1)
    return asof(rows, later, [*SERIES, "direction"], "back", "back", "next", ["known_at"]).select("key", F.col("next.known_at").alias("invalidated_at_ms"))


def log(rows: DataFrame) -> DataFrame:
    """The events that setups leave: detected, accepted, and the final one twice, as a replay would."""
    one = lambda at, seq, status: F.struct(F.col(at).alias("event_time_ms"), F.lit(seq).alias("seq"), status.alias("status"))
    each = F.array(one("confirmation_time_ms", 0, F.lit("CANDIDATE")), one("confirmation_time_ms", 1, F.lit("ACCEPTED")), one("closed_at_ms", 2, F.col("final_status")), one("closed_at_ms", 3, F.col("final_status")))
    return rows.select("key", F.explode(F.filter(each, lambda x: x["event_time_ms"].isNotNull())).alias("x")).select("key", "x.*")


@query("h1_h6_h9_state", f"{REC}{SETUPS}, {OUT} SELECT key, coalesce(final_status, 'ACCEPTED') AS status, coalesce(closed_at_ms, confirmation_time_ms) AS last_event_time_ms, CASE WHEN final_status IS NULL THEN 2 ELSE 3 END AS events, CASE WHEN final_status IS NULL THEN 0 ELSE 1 END AS ignored FROM ou")
def h6(spark, d):
    return lifecycle.state_of(log(closed(spark, d)))


@query("h7_open_setups", f"{REC}{SETUPS}, {OUT} SELECT key, symbol, profile, confirmation_time_ms FROM ou WHERE (final_status IS NULL OR closed_at_ms > (SELECT max(close_time_ms) FROM b) - 43200000) AND {RR} >= 1.49 ORDER BY confirmation_time_ms DESC, key")
def h7(spark, d):
    now = series(spark, d, ["15m"]).agg((F.max("close_time_ms") - 43_200_000).alias("_now"))
    rr = risk.risk_reward(F.col("direction"), F.col("confirmation_price"), F.col("stop_price"), F.col("target"))
    rows = closed(spark, d).join(F.broadcast(now)).where((F.col("final_status").isNull() | (F.col("closed_at_ms") > F.col("_now"))) & (rr >= risk.MINIMUM_RR))
    return rows.select("key", "symbol", "profile", "confirmation_time_ms").orderBy(F.desc("confirmation_time_ms"), "key")


@query("h8_journal", f"{REC}{SETUPS}, {OUT} SELECT key, final_status, closed_at_ms, round(net_r, 6) AS net_r FROM ou WHERE final_status IS NOT NULL AND confirmation_index % 3 <> 0")
def h8(spark, d):
    rows = closed(spark, d)
    taken = rows.where("confirmation_index % 3 <> 0")
    return rounded(lifecycle.journal(rows, log(taken)).select("key", "final_status", "closed_at_ms", "net_r"), "net_r")


@query("h10_quarantine", f"{REC}{SETUPS} SELECT CASE WHEN {RR} < 1.49 THEN 'REJECTED' ELSE 'ACCEPTED' END AS status, CASE WHEN {RR} < 1.49 THEN 'rr_below_minimum' END AS reason, count(*) AS n FROM su GROUP BY ALL")
def h10(spark, d):
    rr = risk.risk_reward(F.col("direction"), F.col("confirmation_price"), F.col("stop_price"), F.col("target"))
    rows = setups(spark, d).withColumn("status", F.lit("ACCEPTED")).withColumn("risk_reward", rr)
    return lifecycle.quarantined(rows).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("h11_downtime_replay", f"{REC}{SETUPS}, {OUT}, cut AS (SELECT max(close_time_ms) - 172800000 AS t FROM b) SELECT key, final_status, closed_at_ms FROM ou, cut WHERE confirmation_time_ms <= t AND (closed_at_ms IS NULL OR closed_at_ms > t)")
def h11(spark, d):
    cut = series(spark, d, ["15m"]).agg((F.max("close_time_ms") - 172_800_000).alias("_t"))
    return closed(spark, d).join(F.broadcast(cut)).where((F.col("confirmation_time_ms") <= F.col("_t")) & (F.col("closed_at_ms").isNull() | (F.col("closed_at_ms") > F.col("_t")))).select("key", "final_status", "closed_at_ms")


@query("h12_expiry_panel", f"{REC}{SETUPS} SELECT key, profile, confirmation_time_ms + CASE WHEN profile = 'scalp' THEN 3 ELSE 12 END * 3600000 AS expires_at_ms FROM su")
def h12(spark, d):
    return setups(spark, d).select("key", "profile", (F.col("confirmation_time_ms") + lifecycle.by_profile(lifecycle.LIFE_HOURS) * 3_600_000).alias("expires_at_ms"))


@query("h13_strategy_figures", f"""{REC}{SETUPS}, {OUT}, marked AS (SELECT *, coalesce(isfinite(net_r) AND isfinite(gross_r) AND isfinite(commission_r) AND commission_r BETWEEN 0 AND 5, false) AS sane FROM ou WHERE final_status IS NOT NULL), both_levels AS (SELECT profile, key, closed_at_ms, net_r, sane FROM marked UNION ALL SELECT 'all', key, closed_at_ms, net_r, sane FROM marked), j AS (SELECT * FROM both_levels WHERE sane), odd_rows AS (SELECT profile, count(*) FILTER (NOT sane) AS anomalies FROM both_levels GROUP BY profile), c AS (SELECT *, sum(net_r) OVER (PARTITION BY profile ORDER BY closed_at_ms, key ROWS UNBOUNDED PRECEDING) AS curve FROM j), t AS (SELECT *, greatest(0, max(curve) OVER (PARTITION BY profile ORDER BY closed_at_ms, key ROWS UNBOUNDED PRECEDING)) AS top FROM c)
SELECT profile, any_value(anomalies) AS anomalies, count(closed_at_ms) AS trades, round(sum(net_r), 5) AS net_r, round(count(*) FILTER (net_r > 0) / count(*), 6) AS win_rate, round(coalesce(sum(net_r) FILTER (net_r > 0), 0) / sum(-net_r) FILTER (net_r < 0), 5) AS profit_factor, round(max(top - curve), 5) AS max_drawdown FROM odd_rows LEFT JOIN t USING (profile) GROUP BY profile""")
def h13(spark, d):
    rows = lifecycle.figures(closed(spark, d).where("final_status is not null"))
    return rounded(rounded(rows, "net_r", "profit_factor", "max_drawdown", digits=5), "win_rate")


@query("h14_anomalies", f"{REC}{SETUPS}, {OUT} SELECT key, commission_r < 0 OR commission_r > 0.75 OR (final_status = 'SL' AND gross_r > 0) AS odd FROM ou WHERE final_status IS NOT NULL")
def h14(spark, d):
    rows = closed(spark, d).where("final_status is not null")
    return rows.select("key", (lifecycle.anomaly(0.75, ("net_r",)) | ((F.col("final_status") == "SL") & (F.col("gross_r") > 0))).alias("odd"))


@query("h15_cost_sensitivity", f"{REC}{SETUPS}, {OUT} SELECT coalesce(profile, 'all') AS profile, coalesce(symbol, 'all') AS symbol, fee, count(*) AS trades, round(avg(gross_r - commission_r * fee), 6) AS expectancy FROM ou, (VALUES (0.0), (1.0), (2.0)) f(fee) WHERE final_status IS NOT NULL GROUP BY fee, CUBE (profile, symbol)")
def h15(spark, d):
    rows = closed(spark, d).where("final_status is not null").withColumn("fee", F.explode(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))))
    cube = rows.cube("profile", "symbol", "fee").agg(F.count(F.lit(1)).alias("trades"), F.round(F.avg(F.col("gross_r") - F.col("commission_r") * F.col("fee")), 6).alias("expectancy"))
    return cube.where("fee is not null").select(F.coalesce("profile", F.lit("all")).alias("profile"), F.coalesce("symbol", F.lit("all")).alias("symbol"), "fee", "trades", "expectancy")


@query("h15_walk_forward", f"""{REC}{SETUPS}, {OUT}, j AS (SELECT profile, symbol, floor(closed_at_ms / 172800000.0)::BIGINT AS span, net_r FROM ou WHERE final_status IS NOT NULL AND commission_r BETWEEN 0 AND 5),
f AS (SELECT DISTINCT span AS fold FROM j), past AS (SELECT fold, profile, symbol, count(*) AS n, avg(net_r) AS r FROM f JOIN j ON span BETWEEN fold - 4 AND fold - 1 GROUP BY ALL),
pp AS (SELECT fold, profile, sum(n)::BIGINT AS train_trades, count(*) FILTER (r > 0) AS chosen FROM past GROUP BY ALL)
SELECT pp.fold, pp.profile, any_value(train_trades) AS train_trades, count(*) AS test_trades, round(avg(net_r), 6) AS expectancy, any_value(pp.chosen) AS chosen, count(*) FILTER (r > 0) AS chosen_trades, round(avg(net_r) FILTER (r > 0), 6) AS chosen_expectancy
FROM pp JOIN j ON span = pp.fold AND j.profile = pp.profile LEFT JOIN past ON past.fold = pp.fold AND past.profile = pp.profile AND past.symbol = j.symbol GROUP BY pp.fold, pp.profile""")
def h15_folds(spark, d):
    return rounded(lifecycle.walk_forward(closed(spark, d).where("final_status is not null"), span_days=2), "expectancy", "chosen_expectancy")


def order_days(spark, d) -> DataFrame:
    """An instant for every order, at differing hours of its day."""
    orders = table(spark, d, "orders")
    return orders.select("o_orderkey", (F.unix_millis(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 1440) * 60_000).alias("ms"))


@query("i1_stock_sessions")
def i1(spark, d):
    return sessions.in_session(order_days(spark, d), sessions.new_york_days(spark, "1991-01-01", "2027-12-31"))


#: Lunar new year and autumn festival, of three days each, and Buddha's birthday, 1992 to 1998.
LUNAR = "('1992-02-04', 1), ('1993-01-23', 1), ('1994-02-10', 1), ('1995-01-31', 1), ('1996-02-19', 1), ('1997-02-08', 1), ('1998-01-28', 1), ('1992-09-11', 1), ('1993-09-30', 1), ('1994-09-20', 1), ('1995-09-09', 1), ('1996-09-27', 1), ('1997-09-16', 1), ('1998-10-05', 1), ('1993-05-28', 0), ('1994-05-18', 0), ('1995-05-07', 0), ('1996-05-24', 0), ('1997-05-14', 0), ('1998-05-03', 0)"


@query("i1_calendar_sessions", f"""WITH o AS (SELECT o_orderkey, epoch_ms(o_orderdate::TIMESTAMP) + o_orderkey % 1440 * 60000 AS ms, CASE o_orderkey % 4 WHEN 0 THEN 'KRX' WHEN 1 THEN 'NIGHT' WHEN 2 THEN 'NY' ELSE 'OTHER' END AS calendar FROM orders),
l(day, span) AS (SELECT a::DATE, b FROM (VALUES {LUNAR}) v(a, b)), d AS (SELECT unnest(generate_series(DATE '1992-01-01', DATE '1997-12-31', INTERVAL 1 DAY))::DATE AS day),
w AS (SELECT day, epoch_ms(day::TIMESTAMP) AS m FROM d WHERE isodow(day) < 6), t AS (SELECT * FROM w WHERE strftime(day, '%m-%d') NOT IN ({", ".join(f"'{x}'" for x in sessions.KOREAN_DAYS)}) AND NOT EXISTS (SELECT 1 FROM l WHERE l.day - l.span <= w.day AND l.day + l.span >= w.day)),
ny AS (SELECT m, day >= (make_date(year(day), 4, 1) + (7 - isodow(make_date(year(day), 4, 1)))::INTEGER) AND day < (make_date(year(day), 10, 31) - (isodow(make_date(year(day), 10, 31)) % 7)::INTEGER) AS summer FROM w),
s AS (SELECT 'KRX' AS calendar, m AS a, m + 23400000 AS z FROM t UNION ALL SELECT 'NIGHT', m + 39600000, m + 93600000 FROM t UNION ALL SELECT 'NY', m + 52200000 - CASE WHEN summer THEN 3600000 ELSE 0 END, m + 75600000 - CASE WHEN summer THEN 3600000 ELSE 0 END FROM ny),
c AS (SELECT calendar, min(a) AS lo, max(z) AS hi FROM s GROUP BY calendar)
SELECT o_orderkey, o.calendar, CASE WHEN ms >= lo AND ms < hi THEN coalesce(ms < z, false) END AS open FROM o ASOF LEFT JOIN s ON o.calendar = s.calendar AND o.ms >= s.a LEFT JOIN c ON c.calendar = o.calendar""")
def i1_calendars(spark, d):
    span = ("1992-01-01", "1997-12-31")
    lunar = spark.sql(f"SELECT to_date(a) AS day, b AS span FROM VALUES {LUNAR} AS v(a, b)")
    korean = {"zone": "Asia/Seoul", "month_days": sessions.KOREAN_DAYS, "holidays": lunar}
    table = sessions.regular_sessions(spark, "KRX", *span, opens="09:00:00", closes="15:30:00", **korean)
    table = table.unionByName(sessions.regular_sessions(spark, "NIGHT", *span, opens="20:00:00", closes="11:00:00", **korean))
    table = table.unionByName(sessions.regular_sessions(spark, "NY", *span, "America/New_York", "09:30:00", "16:00:00"))
    kind = F.element_at(F.array(F.lit("KRX"), F.lit("NIGHT"), F.lit("NY"), F.lit("OTHER")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return sessions.calendar_open(order_days(spark, d).withColumn("calendar", kind), table).select("o_orderkey", "calendar", "open")


@query("i2_i3_commodity_sessions")
def i2(spark, d):
    rows = sessions.commodity_open(order_days(spark, d), sessions.new_york_days(spark, "1991-01-01", "2027-12-31"))
    return rows.withColumn("block_reason", sessions.block_reason(F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("boolean")).otherwise(F.col("open"))))


@query("i4_session_coverage", "WITH s AS (SELECT DISTINCT event_type AS symbol FROM events) SELECT count(*) FILTER (symbol IN ('click', 'view')) AS mapped, count(*) AS total, list(symbol ORDER BY symbol) FILTER (symbol NOT IN ('click', 'view')) AS unmapped FROM s")
def i4(spark, d):
    symbols = table(spark, d, "events").select(F.col("event_type").alias("symbol"))
    return sessions.coverage(symbols, symbols.where("symbol in ('click', 'view')"))


@query("j1_chart_events", f"{WITH}{BREAKS} SELECT br.symbol, br.timeframe, br.kind, br.direction, br.event_open_ms, s.open_time_ms AS swing_open_ms, br.level FROM br JOIN b s ON s.symbol = br.symbol AND s.timeframe = br.timeframe AND s.i = br.swing_index")
def j1(spark, d):
    bars = series(spark, d)
    events = structure.breaks(bars, structure.swings(bars))
    times = bars.select(*SERIES, F.col("i").alias("swing_index"), F.col("open_time_ms").alias("swing_open_ms"))
    return events.join(times, [*SERIES, "swing_index"]).select(*SERIES, "kind", "direction", "event_open_ms", "swing_open_ms", "level")


@query("j3_annotation_counts", f"{WITH}{BREAKS}, {sql.BLOCKS}, {sql.GAPS}, {INTRADAY} SELECT symbol, timeframe, family, count(*) AS n FROM (SELECT symbol, timeframe, 'swings' AS family FROM sw UNION ALL SELECT symbol, timeframe, 'breaks' FROM br UNION ALL SELECT symbol, timeframe, 'order_blocks' FROM ob UNION ALL SELECT symbol, timeframe, 'gaps' FROM g UNION ALL SELECT symbol, timeframe, 'intraday_sweeps' FROM isw) GROUP BY ALL")
def j3(spark, d):
    bars = series(spark, d)
    points = structure.swings(bars)
    events = structure.breaks(bars, points)
    families = {"swings": points, "breaks": events, "order_blocks": zones.order_blocks(bars, events), "gaps": zones.gaps(bars), "intraday_sweeps": liquidity.intraday_sweeps(bars)}
    out = None
    for name, rows in families.items():
        own = rows.groupBy(*SERIES).agg(F.lit(name).alias("family"), F.count(F.lit(1)).alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


@query("j4_recent_events", f"{WITH}{BREAKS}, {INTRADAY}, e AS (SELECT symbol, timeframe, known_at, kind AS event, direction FROM br UNION ALL SELECT symbol, timeframe, known_at, 'sweep', direction FROM isw) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY known_at DESC, event, direction) <= 6")
def j4(spark, d):
    bars = series(spark, d)
    events = structure.breaks(bars, structure.swings(bars)).select(*SERIES, "known_at", F.col("kind").alias("event"), "direction")
    both = events.unionByName(liquidity.intraday_sweeps(bars).select(*SERIES, "known_at", F.lit("sweep").alias("event"), "direction"))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("known_at"), "event", "direction"))).where("_n <= 6").drop("_n")


@query("j5_incoming_list", f"{REC}{SETUPS}, ev AS (SELECT *, {EVIDENCE} FROM su) SELECT key, profile, {POINTS} AS score, confirmation_time_ms FROM ev WHERE profile = 'intraday' AND key <> ''")
def j5(spark, d):
    rows = evidence(setups(spark, d)).where("profile = 'intraday' and key <> ''")
    return rows.select("key", "profile", risk.total(risk.score("evidence")).alias("score"), "confirmation_time_ms").orderBy(F.desc("score"), F.desc("confirmation_time_ms"))


@query("j6_chart_extent", f"{REC}{SETUPS}, v AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) <= 100), l AS (SELECT symbol, arg_max(stop_price, confirmation_index) AS stop_price, arg_max(target, confirmation_index) AS target FROM su GROUP BY symbol) SELECT v.symbol, count(*) AS bars, round(least(min(low), any_value(stop_price), any_value(target)), 6) AS bottom, round(greatest(max(high), any_value(stop_price), any_value(target)), 6) AS top FROM v JOIN l USING (symbol) GROUP BY v.symbol")
def j6(spark, d):
    shown = upkeep.newest(series(spark, d, ["15m"]), 100).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.min("low").alias("low"), F.max("high").alias("high"))
    last = setups(spark, d).groupBy("symbol").agg(F.max_by("stop_price", "confirmation_index").alias("s"), F.max_by("target", "confirmation_index").alias("t"))
    return rounded(shown.join(last, "symbol").select("symbol", "bars", F.least("low", "s", "t").alias("bottom"), F.greatest("high", "s", "t").alias("top")), "bottom", "top")
