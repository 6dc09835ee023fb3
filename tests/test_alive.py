"""Interval joins on time nodes against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alive


@pytest.mark.parametrize("sizes", [1, 3, 7])
def test_cover_makes_up_the_span_exactly(spark, sizes):
    n = 1 << sizes
    spans = [(a, b) for a in range(n) for b in [*range(a + 1, n + 1), None]]
    spans = random.Random(2).sample(spans, min(300, len(spans)))
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(spans)], "k int, a int, b int")
    got = {r["k"]: r["c"] for r in df.select("k", alive.cover(F.col("a"), F.col("b"), sizes).alias("c")).collect()}
    for k, (a, b) in enumerate(spans):
        bars = [i for x in got[k] for i in range(x["_node"] << x["_size"], (x["_node"] + 1) << x["_size"])]
        assert sorted(bars) == list(range(a, n if b is None else b)) and len(got[k]) <= 2 * sizes + 1


def data(seed, n=90, m=150):
    r = random.Random(seed)
    bars = [(s, i) for s in "ab" for i in range(n)]
    facts = []
    for k in range(m):
        a = r.randrange(n)
        low = r.randrange(40) / 2
        facts.append((k, r.choice("ab"), a, r.choice([None, min(n + 5, a + 1 + r.randrange(40))]), low, low + r.choice([0, 0.5, 3.0, 12.0])))
    return bars, facts, r


def lives(f, s, i):
    return f[1] == s and f[2] <= i and (f[3] is None or i < f[3])


def test_touching_against_all_pairs(spark):
    bars, facts, r = data(5)
    queries = [(s, i, x := r.randrange(40) / 2, x + r.choice([0.0, 1.0, 6.0])) for s, i in bars] + [("a", 3, None, 4.0)]
    f = spark.createDataFrame(facts, "k int, s string, from_i int, until_i int, lower double, upper double")
    q = spark.createDataFrame(queries, "s string, i int, lo double, hi double")
    got = [(x["s"], x["i"], x["k"]) for x in alive.touching(q, f, ["s"], ("lo", "hi"), ("lower", "upper"), alive.heights(q)).collect()]
    want = [(s, i, x[0]) for s, i, lo, hi in queries if lo is not None for x in facts if lives(x, s, i) and x[4] <= hi and lo <= x[5]]
    assert sorted(got) == sorted(want) and len(want) > 300


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_against_all_pairs(spark, k):
    bars, facts, r = data(6)
    queries = [(s, i, r.random() < 0.5, r.randrange(-2, 42) / 2) for s, i in bars]
    f = spark.createDataFrame([(*x[:5], x[0] % 7) for x in facts], "k int, s string, from_i int, until_i int, price double, payload int")
    q = spark.createDataFrame(queries, "s string, i int, up boolean, edge double")
    got = {(x["s"], x["i"], x["up"]): [tuple(y) for y in x["near"]] for x in alive.nearest(q, f, ["s"], alive.heights(q), k).collect()}
    for s, i, up, edge in queries:
        best = {}
        for x in facts:
            if lives(x, s, i) and (x[4] > edge if up else x[4] < edge):
                best[x[4]] = min(best.get(x[4], 99), x[0] % 7)
        assert got.get((s, i, up), []) == sorted(best.items(), key=lambda y: y[0] if up else -y[0])[:k], (s, i, up, edge)


def test_counts_and_times_on_bars(spark):
    bars, facts, _ = data(7)
    b = spark.createDataFrame([(s, i, 1000 + 10 * i) for s, i in bars], "s string, i int, close_time_ms bigint")
    rows = spark.createDataFrame([(x[0], x[1], 1000 + 10 * x[2] - x[0] % 10, None if x[3] is None else 1000 + 10 * x[3] - x[0] % 10) for x in facts], "k int, s string, known_at bigint, dead_at bigint")
    f = alive.on_bars(rows, b, ["s"])
    assert {(x["k"], x["from_i"], None if x["until_i"] is None else min(x["until_i"], 90)) for x in f.collect()} == {(x[0], x[2], None if x[3] is None else min(x[3], 90)) for x in facts}
    got = {(x["s"], x["i"]): (x["n"], x["max_k"]) for x in alive.counts(b, f, ["s"], alive.heights(b), F.count("k").alias("n"), F.max("k").alias("max_k")).collect()}
    for s, i in bars:
        own = [x[0] for x in facts if lives(x, s, i)]
        assert got.get((s, i)) == ((len(own), max(own)) if own else None)
