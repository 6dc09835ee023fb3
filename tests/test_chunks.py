"""Chunked windows: the detectors give the same rows whatever the size of a chunk, and a long series spreads over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chunks, indicators, structure, zones

BAR = "symbol string, timeframe string, open_time_ms bigint, close_time_ms bigint, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def walk(spark):
    """Two series on a grid of quarters, one with holes in time and a null."""
    dice, rows = random.Random(4), []
    for symbol in "AB":
        price = 40.0
        for n in range(150):
            if symbol == "B" and dice.random() < 0.3:
                continue
            a, b = price, price + dice.choice([-1.0, -0.25, 0.0, 0.5, 1.0])
            rows.append((symbol, "1m", n * 60_000, n * 60_000 + 59_999, a, max(a, b) + dice.choice([0.0, 0.25]), min(a, b) - dice.choice([0.0, 0.5]), b, None if n == 77 else float(n % 7)))
            price = b + dice.choice([0.0, 0.0, -0.75, 0.75])
    return spark.createDataFrame(rows, BAR)


def plain(bars):
    found = {}
    for r in sorted(bars.collect(), key=lambda r: (r["symbol"], r["open_time_ms"])):
        found.setdefault(r["symbol"], []).append(r)
    return found


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_frames(walk, size):
    bars = chunks.numbered(walk, size)
    near = chunks.own(chunks.with_halo(bars, 3, 2, size).withColumn("back", F.collect_list("i").over(chunks.inside().rowsBetween(-3, 0))).withColumn("ahead", F.sum("volume").over(chunks.inside().rowsBetween(1, 2))))
    rows = chunks.so_far(chunks.so_far(bars, {"top": ("max", F.col("high")), "down": ("last", F.when(F.col("close") < F.col("open"), F.col("i")))}, size=size), {"low_after": ("min", F.col("low"))}, ahead=True, size=size)
    near, rows = ({(r["symbol"], r["i"]): r for r in x.collect()} for x in (near, rows))
    want = plain(walk)
    assert len(near) == len(rows) == sum(len(x) for x in want.values())
    for symbol, own in want.items():
        for i, bar in enumerate(own):
            r, n = rows[symbol, i], near[symbol, i]
            assert r["open_time_ms"] == bar["open_time_ms"]
            assert r["top"] == max((x["high"] for x in own[:i]), default=None) and r["low_after"] == min((x["low"] for x in own[i + 1 :]), default=None)
            assert r["down"] == max((k for k in range(i) if own[k]["close"] < own[k]["open"]), default=None)
            ahead = [x["volume"] for x in own[i + 1 : i + 3] if x["volume"] is not None]
            assert n["back"] == list(range(max(0, i - 3), i + 1)) and n["ahead"] == (sum(ahead) if ahead else None)


def detected(walk):
    bars = structure.indexed(walk)
    points = structure.swings(bars)
    events = structure.breaks(bars, points)
    found = [points, events, zones.order_blocks(bars, events), zones.fills(bars, zones.gaps(bars)), structure.internal_direction(bars)]
    found += [indicators.average_volume(bars), indicators.atr(bars).withColumn("atr", F.round("atr", 9))]
    return [sorted((tuple(r[c] for c in sorted(x.columns)) for r in x.collect()), key=str) for x in found]


def test_detectors_do_not_see_chunks(walk, monkeypatch):
    whole = detected(walk)
    assert all(len(x) > 5 for x in whole)
    monkeypatch.setattr(chunks, "CHUNK", 11)
    assert detected(walk) == whole


def test_an_empty_table_and_a_clashing_order(spark, walk):
    none = chunks.numbered(walk.limit(0), 7)
    assert none.count() == 0 and chunks.so_far(none, {"x": ("max", F.col("high"))}).count() == 0 and structure.swings(none).count() == 0
    assert sorted(r["i"] for r in chunks.numbered(walk.where("symbol = 'A'").orderBy(F.desc("open_time_ms")), 7).collect()) == list(range(150))


def test_no_chunk_is_longer_than_its_size(walk):
    near = chunks.with_halo(chunks.numbered(walk, 10), 2, 0, 10)
    assert max(r["count"] for r in near.groupBy("symbol", "_chunk").count().collect()) == 12
    assert near.where("_own").groupBy("symbol", "_chunk").count().count() == 15 + len(plain(walk)["B"]) // 10 + (len(plain(walk)["B"]) % 10 > 0)
