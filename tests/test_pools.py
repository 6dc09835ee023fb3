"""Pools of swings against a plain loop, and the work they take."""

import random
import time

from pyspark.sql import functions as F

from tidemark.operators import alive, liquidity

POINT = "symbol string, timeframe string, kind string, i int, confirmation_index int, price double"


def made(spark, points, reach):
    """Points of one series as tables: swings, and bars with atr."""
    rows = [("A", "1m", kind, i, i + 2, price) for kind, i, price in points]
    bars = [("A", "1m", i + 2, reach(i)) for i in sorted({p[1] for p in points})]
    return spark.createDataFrame(rows, POINT), spark.createDataFrame(bars, "symbol string, timeframe string, i int, atr double")


def test_pools_with_a_changing_reach(spark):
    dice = random.Random(7)
    points = [(kind, i, dice.choice([float("nan"), *[x / 4 for x in range(160)] * 3])) for i in range(900) for kind in ("high", "low") if dice.random() < 0.4]
    reach = lambda i: [0.0, 1.0, 2.5, 6.0, 40.0][i * i % 5]
    want, pools = [], []
    for kind, i, price in sorted(points, key=lambda p: (p[1], p[0])):
        if reach(i) == 0:
            continue
        near = next((k for k in reversed(range(len(pools))) if pools[k][0] == kind and i - pools[k][1][-1][0] <= 50 and abs(price - pools[k][1][-1][1]) <= reach(i) * 0.5), None)
        if near is None:
            near = len(pools)
            pools.append((kind, []))
        own = pools[near][1]
        own.append((i, price))
        mean = sum(p for _, p in own) / len(own)
        want.append((near, len(own) - 1, kind, [j for j, _ in own], i + 2, str(mean) if mean == mean else "None"))
    found = liquidity.pools(*made(spark, points, reach), 0.5, 50).collect()
    assert sorted((r["pool"], r["version"], r["kind"], r["source_indices"], r["confirmation_index"], str(r["price"])) for r in found) == sorted(want)
    ends = {(n, v): at for n, v, _, _, at, _ in want}
    assert all(r["superseded_at"] == ends.get((r["pool"], r["version"] + 1)) for r in found) and max(ends)[0] > 50 and max(v for _, v in ends) > 5


def test_a_swing_meets_only_pools_in_its_reach(spark):
    n = 30_000
    points = [("high" if i % 2 else "low", i, float(i * 7919 % n)) for i in range(n)]
    began = time.monotonic()
    assert liquidity.pools(*made(spark, points, lambda i: 1.0), 0.1, n).count() == n
    assert time.monotonic() - began < 20  # each swing against all living pools takes minutes


def test_short_facts_are_asked_for_small_nodes_only(spark):
    facts = spark.createDataFrame([(5, 6), (4, 8), (3, 9), (7, 7), (9, 2), (0, None)], "a int, b int")
    got = [[tuple(x) for x in r["c"]] for r in facts.select(alive.cover(F.col("a"), F.col("b"), 4).alias("c")).collect()]
    assert got == [[(0, 5)], [(2, 1)], [(0, 3), (0, 8), (2, 1)], [], [], [(4, 0)]]


def test_one_pool_of_many_swings_without_its_members(spark):
    n = 30_000
    tables = made(spark, [("low", i, 1.0) for i in range(n)], lambda i: 1.0)
    found = liquidity.pools(*tables, members=False)
    assert "source_indices" not in found.columns
    row = found.agg(F.count("*"), F.max("version"), F.max("pool"), F.count("superseded_at"), F.min(F.col("superseded_at") - F.col("confirmation_index"))).first()
    assert tuple(row) == (n, n - 1, 0, n - 1, 1)
