"""Every detector against a plain bar-by-bar fold of a seeded walk."""

import datetime as dt
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidemark.functions import risk
from tidemark.operators import crossing, indicators, lifecycle, liquidity, ranges, sessions, structure, upkeep, zones

BAR = "symbol string, timeframe string, open_time_ms bigint, close_time_ms bigint, open double, high double, low double, close double, volume double, i int"


def bars(spark, opens=None, highs=None, lows=None, closes=None, volumes=None, times=None):
    n = len(next(x for x in (opens, highs, lows, closes, volumes, times) if x))
    closes = closes or [(a + b) / 2 for a, b in zip(highs, lows, strict=True)] if highs else closes or [1.0] * n
    opens = opens or closes
    highs = highs or [max(a, b) for a, b in zip(opens, closes, strict=True)]
    lows = lows or [min(a, b) for a, b in zip(opens, closes, strict=True)]
    times = times or [i * 60_000 for i in range(n)]
    return spark.createDataFrame([("S", "1m", times[i], times[i] + 59_999, float(opens[i]), float(highs[i]), float(lows[i]), float(closes[i]), float((volumes or [1.0] * n)[i]), i) for i in range(n)], BAR)


def points(spark, rows):
    return spark.createDataFrame([("S", "1m", k, i, c, float(p), c * 60_000 + 59_999) for k, i, c, p in rows], "symbol string, timeframe string, kind string, i int, confirmation_index int, price double, known_at bigint")


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def walk(spark):
    """300 bars of a seeded walk on a grid of quarters, so that ties, gaps and touches all occur, and their plain lists."""
    dice = random.Random(20)
    o, h, low, c, price = [], [], [], [], 50.0
    for _ in range(300):
        a, b = price, price + dice.choice([-1.5, -1.0, -0.5, -0.25, 0.0, 0.25, 0.5, 1.0, 1.5])
        o, c = [*o, a], [*c, b]
        h, low = [*h, max(a, b) + dice.choice([0.0, 0.25, 0.5])], [*low, min(a, b) - dice.choice([0.0, 0.25, 0.5])]
        price = b + dice.choice([0.0, 0.0, -0.75, 0.75])
    own = bars(spark, opens=o, highs=h, lows=low, closes=c, times=[i * 900_000 for i in range(300)])
    return SimpleNamespace(df=own.cache(), o=o, h=h, l=low, c=c, n=300)


def swings_of(w, left, right):
    found = []
    for i in range(left, w.n - right):
        if w.h[i] > max(w.h[i - left : i]) and w.h[i] >= max(w.h[i + 1 : i + right + 1]):
            found.append(("high", i, i + right, w.h[i]))
        if w.l[i] < min(w.l[i - left : i]) and w.l[i] <= min(w.l[i + 1 : i + right + 1]):
            found.append(("low", i, i + right, w.l[i]))
    return found


def breaks_of(w, swings):
    """Bar by bar, with the swings that can still be broken."""
    waiting, found, last = [], [], None
    for t in range(w.n):
        above = lambda s, price: price > s[3] if s[0] == "high" else price < s[3]
        waiting += [s for s in swings if s[2] == t and not (t and above(s, w.c[t - 1]))]
        gone = [s for s in waiting if above(s, w.c[t])]
        waiting = [s for s in waiting if s not in gone]
        if gone:
            newest = max(gone, key=lambda s: (s[2], s[1]))
            side = "bullish" if newest[0] == "high" else "bearish"
            found.append((t, "CHoCH" if last not in (None, side) else "BOS", side, newest[1], newest[3]))
            last = side
    return found


@pytest.mark.parametrize(("left", "right"), [(1, 1), (2, 2), (1, 3), (4, 1)])
def test_swings(walk, left, right):
    want = swings_of(walk, left, right)
    assert len(want) > 20 and got(structure.swings(walk.df, left, right), "kind", "i", "confirmation_index", "price") == sorted(want)


@pytest.mark.parametrize("width", [1, 2])
def test_breaks(walk, width):
    want = breaks_of(walk, swings_of(walk, width, width))
    assert {x[1:3] for x in want} == {(k, d) for k in ("BOS", "CHoCH") for d in ("bullish", "bearish")}
    assert got(structure.breaks(walk.df, structure.swings(walk.df, width, width)), "candle_index", "kind", "direction", "swing_index", "level") == sorted(want)


def test_order_blocks_and_mitigation(walk):
    want = {}
    for t, _, side, swing, _ in breaks_of(walk, swings_of(walk, 2, 2)):
        against = [i for i in range(swing + 1, t) if (walk.c[i] < walk.o[i] if side == "bullish" else walk.c[i] > walk.o[i])]
        if against:
            want.setdefault((side, max(i for i in range(t) if (walk.c[i] < walk.o[i] if side == "bullish" else walk.c[i] > walk.o[i]))), t)
    want = [(side, i, t, min(walk.o[i], walk.c[i]), max(walk.o[i], walk.c[i])) for (side, i), t in want.items()]
    blocks = zones.order_blocks(walk.df, structure.breaks(walk.df, structure.swings(walk.df)))
    assert len(want) > 5 and got(blocks, "direction", "candle_index", "confirmation_index", "lower", "upper") == sorted(want)
    through = lambda x, end: next((i for i in range(x[2] + 1, end) if (walk.c[i] < x[3] if x[0] == "bullish" else walk.c[i] > x[4])), None)
    for end, found in ((walk.n, zones.mitigation(walk.df, blocks)), (150, zones.mitigation(walk.df, blocks.withColumn("as_of", F.lit(149)), "as_of"))):
        assert {(r["direction"], r["candle_index"]): r["mitigation_index"] for r in found.collect()} == {x[:2]: through(x, end) for x in want}


def test_gaps_and_fills(walk):
    want = {}
    for i in range(2, walk.n):
        side, lower, upper = ("bullish", walk.h[i - 2], walk.l[i]) if walk.l[i] > walk.h[i - 2] else ("bearish", walk.h[i], walk.l[i - 2])
        if upper > lower:
            depth = [upper - x if side == "bullish" else y - lower for x, y in zip(walk.l[i + 1 :], walk.h[i + 1 :], strict=True)]
            part = min(max([0.0, *depth]) / (upper - lower), 1.0) * 100
            want[i] = (side, i - 2, lower, upper, round(part, 6), next((i + 1 + k for k, x in enumerate(depth) if x >= upper - lower), None))
    found = {r["confirmation_index"]: (r["direction"], r["first_candle_index"], r["lower"], r["upper"], round(r["fill_percent"], 6), r["fill_index"]) for r in zones.fills(walk.df, zones.gaps(walk.df)).collect()}
    assert len(want) > 20 and found == want


def test_a_hair_of_a_gap_left_is_not_full(spark):
    own = bars(spark, highs=[20, 25, 31, 30], lows=[18, 21, 27, 20 + 1e-11])
    row = zones.fills(own, zones.gaps(own).where("confirmation_index = 2")).first()
    assert row["fill_percent"] < 100 and not row["fully_filled"] and row["fill_index"] is None


def test_indicators(walk):
    reach = [walk.h[0] - walk.l[0]] + [max(walk.h[i], walk.c[i - 1]) - min(walk.l[i], walk.c[i - 1]) for i in range(1, walk.n)]
    rows = indicators.atr(walk.df, 5).orderBy("i").limit(6).collect()
    start = sum(reach[:5]) / 5
    assert [r["atr"] for r in rows] == [None] * 4 + [pytest.approx(start), pytest.approx((start * 4 + reach[5]) / 5)]
    volumes = walk.df.withColumn("volume", F.col("close") * 3)
    rows = indicators.average_volume(volumes, 7).orderBy("i").collect()
    assert [r["average_volume"] for r in rows] == [None if i < 6 else pytest.approx(3 * sum(walk.c[i - 6 : i + 1]) / 7) for i in range(walk.n)]


def test_atr_equals_the_recursion_over_many_chunks(spark):
    n, period = 1500, 14
    highs = [100 + (i * 37 % 23) + i % 5 for i in range(n)]
    lows = [h - 1 - i * 11 % 7 for i, h in enumerate(highs)]
    closes = [(h + low) / 2 for h, low in zip(highs, lows, strict=True)]
    reach = [highs[0] - lows[0]] + [max(highs[i] - lows[i], abs(highs[i] - closes[i - 1]), abs(lows[i] - closes[i - 1])) for i in range(1, n)]
    value, want = sum(reach[:period]) / period, {}
    for i in range(period, n):
        value = (value * (period - 1) + reach[i]) / period
        want[i] = value
    rows = indicators.atr(bars(spark, highs=highs, lows=lows, closes=closes), period).where(f"i >= {period}").collect()
    assert len(rows) == n - period and all(r["atr"] == pytest.approx(want[r["i"]], rel=1e-9) for r in rows)


def test_pools(walk):
    swings = sorted(swings_of(walk, 1, 1), key=lambda s: (s[2], s[1], s[0]))
    pools, want = [], []
    for kind, i, known, price in swings:
        near = next((p for p in reversed(pools) if p[0][0] == kind and abs(p[-1][3] - price) <= 0.25 and known - p[-1][2] <= 40), None)
        if near is None:
            pools.append(near := [])
        near.append((kind, i, known, price))
        want.append((kind, known, [m[1] for m in near], sum(m[3] for m in near) / len(near), len(near) > 1))
    found = liquidity.pools(structure.swings(walk.df, 1, 1), walk.df.withColumn("atr", F.lit(0.5)), 0.5, 40).collect()
    assert max(len(x[2]) for x in want) > 2
    assert sorted((r["kind"], r["confirmation_index"], r["source_indices"], r["price"], r["equal_level"]) for r in found) == sorted(want)
    for r in found:
        later = [x["confirmation_index"] for x in found if x["pool"] == r["pool"] and x["version"] == r["version"] + 1]
        assert r["superseded_at"] == (later[0] if later else None)


def test_sweeps(walk):
    points = structure.swings(walk.df, 2, 2).withColumnRenamed("i", "swing")
    want = []
    for kind, i, known, price in swings_of(walk, 2, 2):
        taken = lambda t: walk.h[t] > price > walk.c[t] if kind == "high" else walk.l[t] < price < walk.c[t]  # noqa: B023, E731
        hit = next((t for t in range(known + 1, min(known + 60, walk.n - 1) + 1) if taken(t)), None)
        if hit is not None:
            want.append((kind, i, hit, "bearish" if kind == "high" else "bullish"))
    assert len(want) > 10 and got(liquidity.sweeps(walk.df, points, ["kind", "swing"], 60), "kind", "swing", "candle_index", "direction") == sorted(want)


def test_day_extremes(walk):
    day, last = 96, 288  # bars a day, first bar of the last day
    want = [(kind, pick(line[a : a + day]), a + day - 1) for a in range(0, last, day) for kind, pick, line in (("high", max, walk.h), ("low", min, walk.l))]
    assert got(liquidity.previous_days(walk.df), "kind", "price", "confirmation_index") == sorted(want)
    top, low = max(walk.h[last : walk.n - 1]), min(walk.l[last : walk.n - 1])
    ties = lambda line, price: [i for i in range(last, walk.n - 1) if line[i] == price]
    assert got(liquidity.current_day(walk.df), "kind", "price", "confirmation_index", "source_indices") == [("high", top, walk.n - 2, ties(walk.h, top)), ("low", low, walk.n - 2, ties(walk.l, low))]


def test_range(walk):
    legs = []  # the extreme of each run of swings of one kind
    for s in sorted(swings_of(walk, 2, 2), key=lambda s: (s[2], s[1], s[0])):
        better = legs and legs[-1][0] == s[0] and (s[3] > legs[-1][3] if s[0] == "high" else s[3] < legs[-1][3])
        if not legs or legs[-1][0] != s[0]:
            legs.append(s)
        elif better:
            legs[-1] = s
    start, end = legs[-2:]
    low, high = sorted((start[3], end[3]))
    row = ranges.dealing_ranges(structure.swings(walk.df)).first()
    assert (row["start_index"], row["end_index"], row["low"], row["high"], row["equilibrium"]) == (start[1], end[1], low, high, (low + high) / 2)
    share = sorted(abs(end[3] - row[c]) / (high - low) for c in ("ote_lower", "ote_upper"))
    assert share == [pytest.approx(0.62), pytest.approx(0.79)]


def test_prefix_invariance(walk):
    whole = structure.breaks(walk.df, structure.swings(walk.df, 1, 1))
    for end in (57, 211):
        part = walk.df.where(F.col("i") <= end)
        assert got(structure.breaks(part, structure.swings(part, 1, 1)), "candle_index", "kind") == got(whole.where(F.col("candle_index") <= end), "candle_index", "kind")


def test_entry_limit(spark):
    """The limit lies on the tick and keeps the reward; one tick further does not."""
    dice = random.Random(7)
    asked = [(side, stop + (1 if side == "long" else -1) * dice.randint(20, 90) / 4, stop, tick) for side in ("long", "short") for stop in (31.25, 77.5, 140.0) for tick in (0.05, 0.25, 0.5)]
    rows = spark.createDataFrame(asked, "side string, target double, stop double, tick double").withColumn("limit", risk.entry_limit(F.col("side"), F.col("target"), F.col("stop"), F.col("tick"))).collect()
    for r in rows:
        assert abs(r["limit"] / r["tick"] - round(r["limit"] / r["tick"])) < 1e-9
        reward = lambda price: abs(r["target"] - price) / abs(price - r["stop"])  # noqa: B023, E731
        assert reward(r["limit"]) >= 1.5 - 1e-9 > reward(r["limit"] + (r["tick"] if r["side"] == "long" else -r["tick"]))


SETUP = "key string, symbol string, timeframe string, profile string, direction string, confirmation_index int, confirmation_time_ms bigint, confirmation_price double, stop_price double, target double"


def outcome(spark, low, high, close, at):
    setup = spark.createDataFrame([("k", "S", "1m", "scalp", "short", 0, 59_999, 40.0, 42.0, 35.0)], SETUP)
    return lifecycle.outcomes(setup, bars(spark, highs=[40, high], lows=[40, low], closes=[40, close], times=[0, at])).first()


def test_outcomes(spark):
    won = outcome(spark, 34.5, 41.75, 36, 60_000)
    assert won["final_status"] == "TP1" and won["gross_r"] == 2.5 and won["commission_r"] == pytest.approx(0.01875) and won["net_r"] == pytest.approx(2.48125)
    lost = outcome(spark, 34.5, 42, 40, 60_000)  # both in one bar: the stop counts
    assert lost["final_status"] == "SL" and lost["gross_r"] == -1.0
    late = outcome(spark, 38, 41, 39.5, 3 * 3_600_000)
    assert late["final_status"] == "EXPIRED" and late["gross_r"] == pytest.approx(0.25)
    assert outcome(spark, 38, 41, 39.5, 2 * 3_600_000)["final_status"] is None


def test_acceptance(spark):
    minute = 60_000
    rows = [
        ("a", "z", 0, 5, 2.0, "ACCEPTED"),
        ("b", "y", 4, 6, 2.0, "ACCEPTED"),  # a is open
        ("c", "z", 7, None, 2.0, "ACCEPTED"),  # a's zone pauses
        ("d", "z", 8, None, 2.0, "MISSED_PRICE"),
        ("e", "w", 9, 12, 1.2, "ACCEPTED"),
        ("f", "w", 10, 12, 2.0, "CANDIDATE"),
        ("g", "w", 11, 30, 2.0, "ACCEPTED"),  # f's zone pauses
        ("h", "v", 20, 50, 2.0, "REJECTED"),
        ("i", "z", 45, None, 2.0, "ACCEPTED"),  # the missed price paused nothing
        ("i", "z", 99, None, 2.0, "ACCEPTED"),  # stored before: ignored
        ("b", "y", 8, 30, 2.0, "ACCEPTED"),  # blocked before, now stored
        ("e", "w", 46, 47, 2.0, "MISSED_PRICE"),  # below the least reward before, now stored
        ("e", "w", 48, 60, 2.0, "ACCEPTED"),  # and ignored from then on
        ("h", "v", 52, 55, 1.0, "CANDIDATE"),
    ]
    df = spark.createDataFrame([(k, "S", "scalp", z, at * minute, end and end * minute, rr, status) for k, z, at, end, rr, status in rows], "key string, symbol string, profile string, zone_key string, confirmation_time_ms bigint, closed_at_ms bigint, risk_reward double, status string")
    found = {(r["key"], r["confirmation_time_ms"] // minute): (r["accepted"], r["stored"], r["gate_reasons"]) for r in lifecycle.accepted(df).collect()}
    no = lambda *reasons: (False, False, list(reasons))
    want = {("a", 0): (True, True, []), ("b", 4): no("active_setup_for_symbol_profile"), ("c", 7): no("cooldown_active"), ("d", 8): (False, True, []), ("e", 9): no("rr_below_minimum"), ("f", 10): (False, True, []), ("h", 20): no(), ("i", 99): no(), ("b", 8): (True, True, [])}
    want |= {("g", 11): no("active_setup_for_symbol_profile", "cooldown_active"), ("i", 45): (True, True, []), ("e", 46): (False, True, []), ("e", 48): no(), ("h", 52): no("rr_below_minimum")}
    assert found == want


def decided(rows):
    """Decisions in order of arrival against a store of what was kept, row by row."""
    stored, out = {}, []
    for key, profile, zone, at, end, rr, status in sorted(rows, key=lambda r: (r[3], r[0], r[6])):
        reasons, kept = [], False
        if status in ("ACCEPTED", "CANDIDATE") and rr < 1.49:
            reasons = ["rr_below_minimum"]
        elif status != "REJECTED" and key not in stored:
            mine = [x for x in stored.values() if x[0] == profile]
            if status == "ACCEPTED" and any(x[4] == "ACCEPTED" and (x[3] is None or at < x[3]) for x in mine):
                reasons.append("active_setup_for_symbol_profile")
            if status != "MISSED_PRICE" and any(x[1] == zone and x[4] != "MISSED_PRICE" and x[2] >= at - {"scalp": 30, "intraday": 120}[profile] for x in mine):
                reasons.append("cooldown_active")
            if not reasons:
                stored[key], kept = (profile, zone, at, end, status), True
        out.append((key, at, status, kept, reasons))
    return sorted(out)


def test_acceptance_against_a_store(spark):
    import random

    r, minute, rows = random.Random(12), 60_000, set()
    for _ in range(500):
        k = r.randrange(160)
        at = r.randrange(3000)
        rows.add((f"k{k:03d}", ("scalp", "intraday")[k % 2], f"z{k % 7}", at, r.choice([None, at + r.randrange(1, 90), at + 5]) if r.random() < 0.2 else at + r.randrange(1, 60), r.choice([1.2, 2.0, 2.0, 3.0]), r.choice(["ACCEPTED", "ACCEPTED", "CANDIDATE", "MISSED_PRICE", "REJECTED"])))
    rows = list({(x[0], x[3]): x for x in rows}.values())
    df = spark.createDataFrame([(k, "S", p, z, at * minute, end and end * minute, rr, status) for k, p, z, at, end, rr, status in rows], "key string, symbol string, profile string, zone_key string, confirmation_time_ms bigint, closed_at_ms bigint, risk_reward double, status string")
    got = sorted((x["key"], x["confirmation_time_ms"] // minute, x["status"], x["stored"], x["gate_reasons"]) for x in lifecycle.accepted(df).collect())
    assert got == decided(rows) and sum(x[3] for x in got) > 20


def test_first_crossing_over_many_blocks(spark):
    n = 40_000
    path = [float((i * 7919) % 1009) for i in range(n)]
    path[100], path[17_000], path[33_500] = 2000.0, 3000.0, 4000.0
    own = spark.createDataFrame([("S", "1m", i, p, p, p) for i, p in enumerate(path)], "symbol string, timeframe string, i int, high double, low double, close double")
    asked = [(k, start, price) for k, (start, price) in enumerate([(0, 1500.0), (101, 1500.0), (100, 1500.0), (17_000, 2500.0), (17_001, 2500.0), (33_501, 1500.0), (39_000, 1005.0), (5, 3500.0), (16_383, 1007.5), (39_999, -1.0)])]
    levels = spark.createDataFrame([("S", "1m", *a) for a in asked], "symbol string, timeframe string, k int, start int, price double")
    found = {r["k"]: r["crossed"] for r in crossing.first_crossing(levels, own, ["k"], "start", F.col("close") > F.col("price"), F.col("top_close") > F.col("price")).collect()}
    assert found == {k: next((i for i in range(start, n) if path[i] > price), None) for k, start, price in asked}


def test_overlapping_spans_meet_once(spark):
    spans = [(k, lo, lo + width) for k, (lo, width) in enumerate([(0.0, 1.0), (0.5, 0.0), (1.0, 40.0), (-3.0, 2.0), (39.5, 0.25), (41.0, 0.0)])]
    left = spark.createDataFrame([("S", *x) for x in spans], "symbol string, a int, al double, ah double")
    right = spark.createDataFrame([("S", *x) for x in spans] + [("T", 9, 0.0, 1.0)], "symbol string, b int, bl double, bh double")
    found = sorted((r["a"], r["b"]) for r in crossing.overlapping(left, right, ["symbol"], ("al", "ah"), ("bl", "bh")).collect())
    assert found == sorted((x[0], y[0]) for x in spans for y in spans if x[1] <= y[2] and y[1] <= x[2])


def test_walk_forward_against_loops(spark):
    rng, span = random.Random(31), 7 * 86_400_000
    rows = [(rng.choice(["scalp", "intraday"]), rng.choice("ABC"), rng.randrange(3 * span, 15 * span), rng.gauss(0, 1), rng.choice([0.1, 0.2, -1.0, 9.0, None])) for _ in range(400)]
    rows += [("scalp", "A", 5 * span, float("nan"), 0.1), ("scalp", "A", 5 * span, float("inf"), 0.1), ("scalp", "B", None, 1.0, 0.1)]
    rows = [(*r, r[3] - (r[4] or 0.0)) for r in rows]
    frame = spark.createDataFrame(rows, "profile string, symbol string, closed_at_ms bigint, gross_r double, commission_r double, net_r double")
    sane = [r for r in rows if r[2] is not None and r[4] is not None and 0 <= r[4] <= 5 and abs(r[3]) < 100]
    want = {}
    for fold in range(25):
        for profile in ("scalp", "intraday"):
            past = [r for r in sane if r[0] == profile and fold - 2 <= r[2] // span < fold]
            now = [r for r in sane if r[0] == profile and r[2] // span == fold]
            good = {s for s in "ABC" if sum(r[5] for r in past if r[1] == s) > 0}
            taken = [r[5] for r in now if r[1] in good]
            if past and now:
                want[fold, profile] = (len(past), len(now), sum(r[5] for r in now) / len(now), len(good), len(taken), sum(taken) / len(taken) if taken else None)
    got = lifecycle.walk_forward(frame.withColumn("fold", F.lit(1)), 7, 2).collect()
    assert len(got) == len(want) > 10
    for r in got:
        mine = want[r["fold"], r["profile"]]
        assert (r["train_trades"], r["test_trades"], r["chosen"], r["chosen_trades"]) == (mine[0], mine[1], mine[3], mine[4])
        assert r["expectancy"] == pytest.approx(mine[2]) and r["chosen_expectancy"] == (None if mine[5] is None else pytest.approx(mine[5]))
    assert lifecycle.walk_forward(frame.limit(0)).count() == 0


def test_sessions(spark):
    ms = lambda *a: int(dt.datetime(*a, tzinfo=dt.UTC).timestamp() * 1000)
    days = sessions.new_york_days(spark, "2026-01-01", "2026-12-31")
    rows = [(ms(2026, 6, 16, 13, 30), True), (ms(2026, 6, 16, 13, 29), False), (ms(2026, 12, 15, 14, 29), False), (ms(2026, 12, 15, 20, 59), True), (ms(2026, 4, 3, 15, 0), False), (ms(2026, 11, 27, 19, 0), False), (ms(2026, 7, 3, 15, 0), False)]
    found = sessions.in_session(spark.createDataFrame(rows, "ms bigint, want boolean"), days).collect()
    assert all(r["open"] == r["want"] for r in found)
    week = [(ms(2026, 3, 8, 22, 30), True), (ms(2026, 3, 10, 21, 30), False), (ms(2026, 3, 14, 12, 0), False), (ms(2026, 3, 13, 21, 30), False), (ms(2026, 3, 11, 3, 0), True)]
    found = sessions.commodity_open(spark.createDataFrame(week, "ms bigint, want boolean"), days).collect()
    assert all(r["open"] == r["want"] for r in found)


def test_retention_and_order(spark):
    own = bars(spark, closes=[1.0] * 501).drop("i")
    kept = upkeep.newest(own)
    assert kept.count() == 500 and kept.agg(F.min("open_time_ms")).first()[0] == 60_000
    with pytest.raises(Exception, match="inconsistent"):
        upkeep.checked(own.withColumn("low", F.lit(5.0)), strict=True).collect()
