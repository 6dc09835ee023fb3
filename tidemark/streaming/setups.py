"""Acceptance and outcomes of setups on a stream, and the store that follows it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.risk import MINIMUM_RR, RATE
from ..operators.lifecycle import COOLDOWN_MINUTES, LIFE_HOURS, LIVE
from ..operators.shared import kept, shared_dir

SETUP = ("key", "profile", "zone_key", "direction", "status", "confirmation_price", "stop_price", "target", "risk_reward")
EVENT = "symbol string, profile string, key string, event_time_ms bigint, seq int, status string, stored boolean, ignored boolean, reasons array<string>, gross_r double, commission_r double, net_r double"


def inputs(setups: DataFrame, bars: DataFrame) -> DataFrame:
    """Setups (at confirmation_time_ms) and bars (at close_time_ms) as one frame, batch or stream."""
    own = setups.select("symbol", F.col("confirmation_time_ms").alias("at_ms"), F.lit(1).alias("turn"), *SETUP)
    prices = bars.select("symbol", F.col("close_time_ms").alias("at_ms"), F.lit(0).alias("turn"), "high", "low", "close")
    return prices.unionByName(own, allowMissingColumns=True)


class Lifecycle(StatefulProcessor):
    """Folds one symbol's bars and setups: open setups, the last start of each zone and the stored keys are states of their own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "key string", "profile string, long boolean, price double, stop double, target double, ends bigint")
        self.zones = handle.getMapState("zones", "profile string, zone string", "at bigint")
        self.known = handle.getMapState("known", "key string", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat(list(rows)).sort_values(["at_ms", "turn", "key"], kind="stable")
        live = {k[0]: tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        zones = {tuple(k): v[0] for k, v in self.zones.iterator()} if self.zones.exists() else {}
        before, begun, out = set(live), dict(zones), []
        for row in own.itertuples(index=False):
            at = int(row.at_ms)
            if row.turn == 0:
                closed = {k: self.closes(v, row, at) for k, v in live.items()}
                for k, (status, leave) in ((k, x) for k, x in closed.items() if x):
                    profile, long, price, stop, _, _ = live.pop(k)
                    gross = -1.0 if status == "SL" else (1 if long else -1) * (leave - price) / abs(price - stop)
                    cost = RATE * (price + leave) / abs(price - stop)
                    out.append((key[0], profile, k, at, 1, status, True, False, [], gross, cost, gross - cost))
                continue
            stored, ignored, reasons = self.decide(row, at, live, zones)
            if stored:
                self.known.updateValue((row.key,), (at,))
                if row.status != "MISSED_PRICE":
                    zones[row.profile, row.zone_key] = at
                if row.status == "ACCEPTED":
                    live[row.key] = (row.profile, row.direction == "long", row.confirmation_price, row.stop_price, row.target, at + LIFE_HOURS[row.profile] * 3_600_000)
            out.append((key[0], row.profile, row.key, at, 0, row.status if stored else "IGNORED" if ignored else "REJECTED", stored, ignored, reasons, None, None, None))
        end = int(own["at_ms"].max())
        for k in before - set(live):
            self.open.removeKey((k,))
        for k in set(live) - before:
            self.open.updateValue((k,), live[k])
        for zone, at in zones.items():
            if at < end - COOLDOWN_MINUTES[zone[0]] * 60_000:
                if zone in begun:
                    self.zones.removeKey(zone)
            elif begun.get(zone) != at:
                self.zones.updateValue(zone, (at,))
        names = [c.split()[0] for c in EVENT.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"gross_r": "float64", "commission_r": "float64", "net_r": "float64"})

    @staticmethod
    def closes(setup: tuple, bar, at: int) -> tuple[str, float] | None:
        """How a bar closes an open setup: the stop before the target, the target before expiry."""
        _, long, _, stop, target, ends = setup
        if bar.low <= stop if long else bar.high >= stop:
            return "SL", stop
        if bar.high >= target if long else bar.low <= target:
            return "TP1", target
        return ("EXPIRED", bar.close) if at >= ends else None

    def decide(self, row, at: int, live: dict, zones: dict) -> tuple[bool, bool, list[str]]:
        """Whether a setup is stored, whether it is ignored as stored before, and the gates that stop it."""
        if row.status == "REJECTED":
            return False, False, []
        if row.status in ("CANDIDATE", *LIVE) and not row.risk_reward >= MINIMUM_RR:
            return False, False, ["rr_below_minimum"]
        if self.known.containsKey((row.key,)):
            return False, True, []
        reasons = []
        if row.status == "ACCEPTED" and any(v[0] == row.profile for v in live.values()):
            reasons.append("active_setup_for_symbol_profile")
        if row.status in ("ACCEPTED", "CANDIDATE") and zones.get((row.profile, row.zone_key), -(2**62)) >= at - COOLDOWN_MINUTES[row.profile] * 60_000:
            reasons.append("cooldown_active")
        return not reasons, False, reasons

    def close(self) -> None:
        """Nothing to release."""


def events(stream: DataFrame) -> DataFrame:
    """The decision on every setup of a stream of inputs() and the close of every accepted one, as events; batch form: lifecycle.accepted over lifecycle.outcomes.

    On one time bars come before setups, setups by their keys. A setup must not come in a later batch than a bar that closed
    after it; bars before it don't touch it. Rows of a symbol in one micro-batch are in memory; what a trigger may read
    bounds them. State is the open setups, the zones within the cooldown and all stored keys (in RocksDB, never listed).
    A null reward counts as below the least one. The session's state store must be RocksDB (rocksdb()).
    """
    return stream.groupBy("symbol").transformWithStateInPandas(Lifecycle(), EVENT, "Append", "None")


def rocksdb(spark: SparkSession) -> None:
    """Has the session's streams keep their state in RocksDB, which several state variables need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def keep_events(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch's events in a folder of its own, then one commit row that names it.

    Setups, events and journal are read from the same commits, so no reader sees one without the others. A batch that is
    run again commits once more under its number and the last commit holds; a write that never got to its commit is never read.
    """

    def store(batch: DataFrame, number: int) -> None:
        folder = f"{path}/data/{number}-{uuid.uuid4().hex}"
        batch.write.parquet(folder)
        done = spark.range(1).select(F.lit(number).cast("bigint").alias("number"), F.unix_micros(F.current_timestamp()).alias("at"), F.lit(folder).alias("folder"))
        done.write.mode("append").parquet(f"{path}/commits")

    return store


def replayed(setups: DataFrame, bars: DataFrame, spans: int = 4, files: int = 64) -> DataFrame:
    """The event log that setups and bars leave when they are streamed through a store, in batches of `files` files of `spans` spans of time in order.

    Both are written to the shared folder, a symbol in one file a span, so that no batch brings a setup after later bars.
    """
    spark = setups.sparkSession
    rows = kept(inputs(setups, bars))
    folder = f"{shared_dir(spark)}/kept/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    first, last = rows.agg(F.min("at_ms"), F.max("at_ms")).first()
    width = ((last or 0) - (first or 0)) // spans + 1
    for n in range(spans):
        part = F.floor((F.col("at_ms") - F.lit(first or 0)) / width) == n
        rows.where(part).repartition("symbol").write.parquet(f"{folder}/in/{n}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    rocksdb(spark)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in/*")
        sink = events(stream).writeStream.foreachBatch(keep_events(spark, f"{folder}/store"))
        sink.option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return stored_events(spark, f"{folder}/store")


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    """All events of a store that are committed, each batch once."""
    rows = spark.read.schema("number bigint, at bigint, folder string").parquet(f"{path}/commits")
    folders = rows.groupBy("number").agg(F.max_by("folder", F.struct("at", "folder")).alias("folder"))
    return spark.read.schema(EVENT).parquet(*[r["folder"] for r in folders.collect()])  # one row a batch


def stored_setups(rows: DataFrame) -> DataFrame:
    """The stored setups of an event log with their state: status, since when it holds, and the result of closed ones."""
    last = F.struct("event_time_ms", "seq")
    one = lambda c: F.max_by(c, last).alias(c)
    return rows.where("stored").groupBy("symbol", "profile", "key").agg(F.min("event_time_ms").alias("confirmation_time_ms"), F.max("event_time_ms").alias("last_event_time_ms"), *[one(c) for c in ("status", "gross_r", "commission_r", "net_r")])


def stored_journal(rows: DataFrame) -> DataFrame:
    """Closed setups of an event log."""
    return rows.where("seq = 1").select("symbol", "profile", "key", F.col("status").alias("final_status"), F.col("event_time_ms").alias("closed_at_ms"), "gross_r", "commission_r", "net_r")


def purged(rows: DataFrame, before_ms: int) -> DataFrame:
    """An event log without the decisions that stored nothing and are older than before_ms."""
    return rows.where(F.col("stored") | (F.col("event_time_ms") >= before_ms))
