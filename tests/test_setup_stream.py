"""Acceptance and outcomes on a stream against the batch operators, in any cut of the input, and the store behind it."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lifecycle
from tidemark.streaming import setups as streaming

BAR = "symbol string, timeframe string, open_time_ms bigint, close_time_ms bigint, open double, high double, low double, close double, volume double, i int"
SETUP = "row string, key string, symbol string, timeframe string, profile string, zone_key string, direction string, status string, confirmation_index int, confirmation_time_ms bigint, confirmation_price double, stop_price double, target double, risk_reward double"


@pytest.fixture(scope="module")
def market(spark):
    """Two symbols' quarter-hour bars and setups of every status, with keys that recur and a reward of null."""
    dice, bars, setups = random.Random(8), [], []
    for symbol in ("A", "B"):
        price = 100.0
        for i in range(200):
            a, price = price, price + dice.choice([-1.0, -0.5, 0.0, 0.5, 1.0])
            bars.append((symbol, "15m", i * 900_000, i * 900_000 + 899_999, a, max(a, price) + 0.25, min(a, price) - 0.25, price, 1.0, i))
            if dice.random() < 0.5:
                long, risk = dice.random() < 0.5, dice.choice([1.0, 2.0, 4.0])
                sign, reward = (1 if long else -1), dice.choice([1.0, 1.6, 2.0, None])
                status = dice.choice(["ACCEPTED"] * 4 + ["CANDIDATE", "MISSED_PRICE", "REJECTED"])
                key = f"{symbol}{i // 3}"
                setups.append((f"{symbol}:{i}", key, symbol, "15m", dice.choice(["scalp", "intraday"]) if i % 3 == 0 else "scalp", f"z{dice.randrange(3)}", "long" if long else "short", status, i, i * 900_000 + 899_999, price, price - sign * risk, price + sign * risk * (reward or 1.6), reward))
    seen, own = {}, []
    for s in setups:  # a key keeps its profile
        own.append((*s[:4], seen.setdefault(s[1], s[4]), *s[5:]))
    return spark.createDataFrame(bars, BAR), spark.createDataFrame(own, SETUP)


def streamed(spark, market, folder, cuts):
    bars, setups = market
    rows, edges = streaming.inputs(setups, bars), [-1, *cuts, 2**62]
    for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        rows.where((F.col("at_ms") > a) & (F.col("at_ms") <= b)).coalesce(1).write.parquet(f"{folder}/in/{n}")
    streaming.rocksdb(spark)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    store = streaming.keep_events(spark, f"{folder}/store")

    def twice(batch, number):
        store(batch, number)
        if number % 2:
            store(batch, number)

    query = streaming.events(stream).writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/cp").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return streaming.stored_events(spark, f"{folder}/store")


@pytest.mark.parametrize("cuts", [[], [7_000_000, 30_000_000, 90_000_000]])
def test_stream_equals_batch(spark, market, tmp_path, cuts):
    bars, setups = market
    closed = lifecycle.outcomes(setups.withColumn("_key", F.col("key")).withColumn("key", F.col("row")), bars).withColumn("key", F.col("_key"))
    batch = lifecycle.accepted(closed).collect()
    log = streamed(spark, market, str(tmp_path), cuts)
    rows = log.collect()
    want = sorted((r["symbol"], r["key"], r["confirmation_time_ms"], r["stored"], r["ignored"], tuple(r["gate_reasons"])) for r in batch)
    assert {s for r in batch for s in r["gate_reasons"]} == {"rr_below_minimum", "active_setup_for_symbol_profile", "cooldown_active"} and any(r["ignored"] for r in batch)
    assert sorted((r["symbol"], r["key"], r["event_time_ms"], r["stored"], r["ignored"], tuple(r["reasons"])) for r in rows if r["seq"] == 0) == want
    ends = sorted((r["key"], r["final_status"], r["closed_at_ms"], round(r["gross_r"], 9), round(r["net_r"], 9)) for r in batch if r["accepted"] and r["final_status"])
    assert {x[1] for x in ends} == {"SL", "TP1", "EXPIRED"}
    assert sorted((r["key"], r["final_status"], r["closed_at_ms"], round(r["gross_r"], 9), round(r["net_r"], 9)) for r in streaming.stored_journal(log).collect()) == ends
    state = {r["key"]: r["status"] for r in streaming.stored_setups(log).collect()}
    assert state == {r["key"]: (r["final_status"] if r["accepted"] and r["final_status"] else r["status"]) for r in batch if r["stored"]}


def test_a_batch_run_again_and_a_lost_write_change_nothing(spark, tmp_path):
    row = ("A", "scalp", "k", 5, 0, "ACCEPTED", True, False, [], None, None, None)
    none = ("A", "scalp", "l", 2, 0, "REJECTED", False, False, ["rr_below_minimum"], None, None, None)
    batch = spark.createDataFrame([row, none], streaming.EVENT)
    store = streaming.keep_events(spark, str(tmp_path))
    store(batch, 0)
    batch.write.parquet(f"{tmp_path}/data/1-lost")
    store(batch, 0)
    store(batch.limit(0), 1)
    log = streaming.stored_events(spark, str(tmp_path))
    assert log.count() == 2 and streaming.stored_setups(log).count() == 1 and streaming.stored_journal(log).count() == 0
    assert [r["key"] for r in streaming.purged(log, 3).collect()] == ["k"]
