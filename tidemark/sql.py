"""DuckDB SQL for the queries' results, built from common table expressions that each say what one step means."""

from __future__ import annotations

TICKS = "ticks AS (SELECT event_type AS symbol, epoch_ms(ts) AS ms, event_id AS seq, value::DOUBLE AS price, 1.0::DOUBLE AS quantity FROM events WHERE value IS NOT NULL)"
TRADES = """ticks AS (SELECT l_returnflag || l_linestatus AS symbol, epoch_ms(l_shipdate) AS ms, row(l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_partkey, l_suppkey) AS seq,
      l_extendedprice / l_quantity AS price, l_quantity::DOUBLE AS quantity FROM lineitem)"""
LENGTHS = {"15m": 900_000, "1h": 3_600_000, "4h": 14_400_000, "1d": 86_400_000}


def bars(timeframes: tuple[str, ...] = ("15m", "1h", "4h"), ticks: str = TICKS) -> str:
    """CTE b: indexed bars."""
    named = ", ".join(f"('{t}', {LENGTHS[t]}::BIGINT)" for t in timeframes)
    return f"""{ticks},
tf(timeframe, length) AS (VALUES {named}),
pt AS (SELECT symbol, timeframe, ms // length * length AS open_time_ms, length, ms, seq, price, quantity FROM ticks, tf),
raw AS (SELECT symbol, timeframe, open_time_ms, open_time_ms + length - 1 AS close_time_ms, arg_min(price, row(ms, seq)) AS open, max(price) AS high,
      min(price) AS low, arg_max(price, row(ms, seq)) AS close, sum(quantity) AS volume FROM pt WHERE open_time_ms + length - 1 <= (SELECT max(ms) FROM ticks) GROUP BY symbol, timeframe, open_time_ms, length),
b AS (SELECT *, (row_number() OVER (PARTITION BY symbol, timeframe ORDER BY open_time_ms) - 1)::INTEGER AS i FROM raw)"""


W = "PARTITION BY symbol, timeframe ORDER BY i"
S = "symbol, timeframe"


def swings(left: int = 2, right: int = 2, name: str = "sw") -> str:
    return f"""{name}_w AS (SELECT *, max(high) OVER p AS hb, min(low) OVER p AS lb, max(high) OVER f AS ha, min(low) OVER f AS la, count(*) OVER f AS n, lead(close_time_ms, {right}) OVER ({W}) AS known_at
      FROM b WINDOW p AS ({W} ROWS BETWEEN {left} PRECEDING AND 1 PRECEDING), f AS ({W} ROWS BETWEEN 1 FOLLOWING AND {right} FOLLOWING)),
{name} AS (SELECT {S}, 'high' AS kind, i, i + {right} AS confirmation_index, high AS price, known_at FROM {name}_w WHERE i >= {left} AND n = {right} AND high > hb AND high >= ha
      UNION ALL SELECT {S}, 'low', i, i + {right}, low, known_at FROM {name}_w WHERE i >= {left} AND n = {right} AND low < lb AND low <= la)"""


def breaks(points: str = "sw", name: str = "br") -> str:
    return f"""{name}_x AS (SELECT s.symbol, s.timeframe, s.kind, s.i AS swing_index, s.confirmation_index, s.price, min(x.i) AS candle_index FROM {points} s
      LEFT JOIN b c ON c.symbol = s.symbol AND c.timeframe = s.timeframe AND c.i = s.confirmation_index - 1
      JOIN b x ON x.symbol = s.symbol AND x.timeframe = s.timeframe AND x.i >= s.confirmation_index AND CASE WHEN s.kind = 'high' THEN x.close > s.price ELSE x.close < s.price END
      WHERE NOT coalesce(CASE WHEN s.kind = 'high' THEN c.close > s.price ELSE c.close < s.price END, false) GROUP BY ALL),
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {S}, candle_index ORDER BY confirmation_index DESC, swing_index DESC) AS nth FROM {name}_x),
{name}_d AS (SELECT {S}, candle_index, CASE WHEN kind = 'high' THEN 'bullish' ELSE 'bearish' END AS direction, swing_index, price AS level FROM {name}_n WHERE nth = 1),
{name} AS (SELECT d.*, CASE WHEN lag(direction) OVER (PARTITION BY d.symbol, d.timeframe ORDER BY candle_index) <> direction THEN 'CHoCH' ELSE 'BOS' END AS kind, b.close_time_ms AS known_at, b.open_time_ms AS event_open_ms
      FROM {name}_d d JOIN b ON b.symbol = d.symbol AND b.timeframe = d.timeframe AND b.i = d.candle_index)"""


BLOCKS = f"""ob_c AS (SELECT br.*, x.i AS c, least(x.open, x.close) AS lower, greatest(x.open, x.close) AS upper,
      row_number() OVER (PARTITION BY br.symbol, br.timeframe, br.candle_index ORDER BY x.i DESC) AS nth
      FROM br JOIN b x ON x.symbol = br.symbol AND x.timeframe = br.timeframe AND x.i > br.swing_index AND x.i < br.candle_index
      AND CASE WHEN br.direction = 'bullish' THEN x.close < x.open ELSE x.close > x.open END),
ob_d AS (SELECT *, row_number() OVER (PARTITION BY {S}, direction, c ORDER BY candle_index) AS again FROM ob_c WHERE nth = 1),
ob AS (SELECT {S}, direction, c AS candle_index, candle_index AS confirmation_index, lower, upper, kind AS source_kind, swing_index AS source_swing_index, known_at FROM ob_d WHERE again = 1)"""
MITIGATION = """obm AS (SELECT ob.*, m.i AS mitigation_index, m.close_time_ms AS dead_at FROM ob LEFT JOIN LATERAL (SELECT x.i, x.close_time_ms FROM b x WHERE x.symbol = ob.symbol AND x.timeframe = ob.timeframe
      AND x.i > ob.confirmation_index AND CASE WHEN ob.direction = 'bullish' THEN x.close < ob.lower ELSE x.close > ob.upper END ORDER BY x.i LIMIT 1) m ON true)"""
GAPS = f"""g_l AS (SELECT *, lag(high, 2) OVER ({W}) AS h, lag(low, 2) OVER ({W}) AS l FROM b),
g AS (SELECT {S}, 'bullish' AS direction, i - 2 AS first_candle_index, i AS confirmation_index, h AS lower, low AS upper, close_time_ms AS known_at FROM g_l WHERE low > h
      UNION ALL SELECT {S}, 'bearish', i - 2, i, high, l, close_time_ms FROM g_l WHERE high < l)"""
FILLS = """gd AS (SELECT g.symbol, g.timeframe, g.confirmation_index, CASE WHEN g.direction = 'bullish' THEN g.upper - min(x.low) ELSE max(x.high) - g.lower END AS depth,
      min(x.i) FILTER (CASE WHEN g.direction = 'bullish' THEN g.upper - x.low ELSE x.high - g.lower END >= g.upper - g.lower) AS fill_index
      FROM g JOIN b x ON x.symbol = g.symbol AND x.timeframe = g.timeframe AND x.i > g.confirmation_index GROUP BY g.symbol, g.timeframe, g.confirmation_index, g.direction, g.upper, g.lower),
gf AS (SELECT g.*, coalesce(depth, 0) >= upper - lower AS fully_filled, CASE WHEN coalesce(depth, 0) >= upper - lower THEN 100.0 ELSE least(round(greatest(coalesce(depth, 0), 0) / (upper - lower) * 100, 8), 99.99999999) END AS fill_percent,
      fill_index, x.close_time_ms AS dead_at FROM g LEFT JOIN gd USING (symbol, timeframe, confirmation_index) LEFT JOIN b x ON x.symbol = g.symbol AND x.timeframe = g.timeframe AND x.i = gd.fill_index)"""
ZONES = f"""z_all AS (SELECT {S}, 'OB' AS zone_kind, direction, lower, upper, candle_index AS formed, 0 AS r1, confirmation_index AS r2, known_at, dead_at FROM obm
      UNION ALL SELECT {S}, 'FVG', direction, lower, upper, confirmation_index, 1, confirmation_index, known_at, dead_at FROM gf),
z AS (SELECT z_all.*, b.open_time_ms AS zone_open_ms, b.close_time_ms AS zone_close_ms FROM z_all JOIN b ON b.symbol = z_all.symbol AND b.timeframe = z_all.timeframe AND b.i = z_all.formed)"""


def atr(period: int = 14) -> str:
    """CTE a: b with atr (needs WITH RECURSIVE)."""
    return f"""tr AS (SELECT *, CASE WHEN i = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) END AS tr FROM b),
fold AS (SELECT {S}, {period - 1} AS i, avg(tr) AS atr FROM tr WHERE i < {period} GROUP BY {S} HAVING count(*) = {period}
      UNION ALL SELECT f.symbol, f.timeframe, f.i + 1, (f.atr * {period - 1} + tr.tr) / {period} FROM fold f JOIN tr ON tr.symbol = f.symbol AND tr.timeframe = f.timeframe AND tr.i = f.i + 1),
a AS (SELECT b.*, fold.atr FROM b LEFT JOIN fold USING (symbol, timeframe, i))"""


DAYS = f"""dd AS (SELECT {S}, open_time_ms // 86400000 AS day, max(high) AS h, min(low) AS l, max(i) AS confirmation_index FROM b GROUP BY ALL),
dl AS (SELECT *, lead(day) OVER (PARTITION BY {S} ORDER BY day) AS later FROM dd),
pd AS (SELECT {S}, kind, price, (SELECT min(x.i) FROM b x WHERE x.symbol = d.symbol AND x.timeframe = d.timeframe AND x.open_time_ms // 86400000 = d.day AND CASE WHEN kind = 'high' THEN x.high = price ELSE x.low = price END) AS source_index, confirmation_index
      FROM (SELECT *, 'high' AS kind, h AS price FROM dl UNION ALL SELECT *, 'low', l FROM dl) d WHERE later IS NOT NULL)"""
LEGS = f"""rn AS (SELECT *, row_number() OVER o AS nth, CASE WHEN lag(kind) OVER o = kind THEN 0 ELSE 1 END AS fresh FROM sw WINDOW o AS (PARTITION BY {S} ORDER BY confirmation_index, i, kind)),
rr AS (SELECT *, sum(fresh) OVER (PARTITION BY {S} ORDER BY nth) AS run FROM rn),
best AS (SELECT *, row_number() OVER (PARTITION BY {S}, run ORDER BY CASE WHEN kind = 'high' THEN -price ELSE price END, nth) AS top FROM rr),
ext AS (SELECT {S}, run, kind, i, confirmation_index, price FROM best WHERE top = 1),
legs AS (SELECT e.symbol, e.timeframe, e.run, CASE WHEN e.kind = 'high' THEN 'bullish' ELSE 'bearish' END AS direction, s.i AS start_index, e.i AS end_index, greatest(s.confirmation_index, e.confirmation_index) AS confirmation_index,
      least(s.price, e.price) AS low, greatest(s.price, e.price) AS high, CASE WHEN e.kind = 'high' THEN e.price > s.price ELSE s.price > e.price END AS fine
      FROM ext e JOIN ext s ON s.symbol = e.symbol AND s.timeframe = e.timeframe AND s.run = e.run - 1),
bands AS (SELECT *, (low + high) / 2 AS equilibrium, CASE WHEN direction = 'bullish' THEN high - (high - low) * 0.79 ELSE low + (high - low) * 0.62 END AS ote_lower, CASE WHEN direction = 'bullish' THEN high - (high - low) * 0.62 ELSE low + (high - low) * 0.79 END AS ote_upper FROM legs)"""


def rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n.rpartition('.')[2]}" for n in names)
