"""Keeping bar tables: merges, retention, gaps, audits, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import SERIES, TIMEFRAMES, sound

KEY = [*SERIES, "open_time_ms"]
VALUES = ("open", "high", "low", "close", "volume")


def newest(bars: DataFrame, keep: int = 500) -> DataFrame:
    """The newest `keep` bars of every series. Spark limits ranks before the shuffle, so a long series sends no more than that from each task."""
    rank = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("open_time_ms")))
    return bars.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


def upserted(updates: DataFrame, sequence: str, keep: int = 500) -> DataFrame:
    """The last write of every bar, then retention."""
    last = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(sequence)))
    return newest(updates.withColumn("_n", last).where("_n = 1").drop("_n", sequence), keep)


def merged(stored: DataFrame, incoming: DataFrame, keep: int | None = 500) -> DataFrame:
    """Stored and incoming bars, of which incoming ones hold; then retention."""
    both = stored.withColumn("_from", F.lit(0)).unionByName(incoming.select(*stored.columns).withColumn("_from", F.lit(1)))
    best = both.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in stored.columns if c not in KEY]), "_from").alias("_b"))
    rows = best.select(*KEY, "_b.*").select(*stored.columns)
    return newest(rows, keep) if keep else rows


def reconciled(stored: DataFrame, incoming: DataFrame, keep: int = 500) -> DataFrame:
    """merged() with emitted: whether a bar is newer than all that its series had; of a series that had none only the last bar is."""
    latest = stored.groupBy(*SERIES).agg(F.max("open_time_ms").alias("_latest"))
    rows = merged(stored, incoming, keep).join(latest, SERIES, "left")
    last = F.max("open_time_ms").over(Window.partitionBy(*SERIES))
    return rows.withColumn("emitted", F.when(F.col("_latest").isNull(), F.col("open_time_ms") == last).otherwise(F.col("open_time_ms") > F.col("_latest"))).drop("_latest")


def differences(stored: DataFrame, authoritative: DataFrame) -> DataFrame:
    """Per series the bars checked, changed, missing from the store and extra in it, and whether all agree."""
    pack = lambda df, name: df.select(*KEY, F.struct(*VALUES).alias(name))
    both = pack(stored, "_s").join(pack(authoritative, "_a"), KEY, "full_outer")
    flag = lambda c: F.count(F.when(c, 1))
    rows = both.groupBy(*SERIES).agg(flag(F.col("_a").isNotNull()).alias("checked"), flag(F.col("_s").isNotNull() & F.col("_a").isNotNull() & (F.col("_s") != F.col("_a"))).alias("changed"), flag(F.col("_s").isNull()).alias("missing"), flag(F.col("_a").isNull()).alias("extra"))
    return rows.withColumn("complete", (F.col("changed") == 0) & (F.col("missing") == 0))


def accepted(arrivals: DataFrame, order: list[str]) -> DataFrame:
    """Arrivals that are newer than all that came before in their series: repeats and late bars are dropped."""
    before = F.max("open_time_ms").over(Window.partitionBy(*SERIES).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return arrivals.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("open_time_ms") > F.col("_b"))).drop("_b")


def interval() -> Column:
    """The length of a row's timeframe."""
    return F.create_map(*[F.lit(x) for kv in TIMEFRAMES.items() for x in kv])[F.col("timeframe")]


def gaps(bars: DataFrame) -> DataFrame:
    """Bars that come later than one interval after the one before, with missing_bars."""
    last = F.lag("open_time_ms").over(Window.partitionBy(*SERIES).orderBy("open_time_ms"))
    rows = bars.select(*KEY, last.alias("previous_open_ms")).where(F.col("open_time_ms") > F.col("previous_open_ms") + interval())
    return rows.withColumn("missing_bars", ((F.col("open_time_ms") - F.col("previous_open_ms")) / interval() - 1).cast("long"))


def freshness(bars: DataFrame, symbols: DataFrame, timeframes: list[str], now_ms: Column, needed: int = 500, slack_ms: int = 120_000) -> DataFrame:
    """Every followed series with its bars, age_ms and whether it is missing, underfilled or stale. The grid is of two small dimensions."""
    grid = symbols.select("symbol").distinct().withColumn("timeframe", F.explode(F.array(*[F.lit(t) for t in timeframes])))
    have = bars.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("bars"), F.max("close_time_ms").alias("_close"))
    rows = grid.join(have, SERIES, "left").withColumn("age_ms", now_ms - F.col("_close")).withColumn("bars", F.coalesce("bars", F.lit(0)))
    return rows.select(*SERIES, "bars", "age_ms", F.col("_close").isNull().alias("missing"), ((F.col("bars") > 0) & (F.col("bars") < needed)).alias("underfilled"), F.coalesce(F.col("age_ms") > interval() + slack_ms, F.lit(False)).alias("stale"))


def freshness_status(report: DataFrame) -> DataFrame:
    """One row: counts, the greatest age and ok or degraded."""
    flag = lambda c: F.count(F.when(F.col(c), 1))
    row = report.agg(F.count(F.lit(1)).alias("series"), flag("missing").alias("missing"), flag("underfilled").alias("underfilled"), flag("stale").alias("stale"), F.max("age_ms").alias("max_age_ms"))
    return row.withColumn("status", F.when((F.col("missing") + F.col("underfilled") + F.col("stale")) == 0, "ok").otherwise("degraded"))


def checked(bars: DataFrame, strict: bool = False) -> DataFrame:
    """bars with problem: values_missing, inconsistent, not_increasing or null. strict raises an error instead."""
    last = F.lag("open_time_ms").over(Window.partitionBy(*SERIES).orderBy("open_time_ms"))
    finite = F.coalesce(*[F.lit(None).cast("boolean")], F.lit(True))
    for c in VALUES:
        finite = finite & F.col(c).isNotNull() & ~F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(True)) & (F.abs(F.col(c).cast("double")) < float("inf"))
    problem = F.when(~finite, "values_missing").when(~sound(), "inconsistent").when(F.coalesce(F.col("_last") == F.col("open_time_ms"), F.lit(False)), "not_increasing")
    rows = bars.withColumn("_last", last).withColumn("problem", problem).drop("_last")
    return rows.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("bar "), "problem"))).otherwise(F.lit(None).cast("string"))) if strict else rows


def audited(bars: DataFrame, needed: int = 500) -> DataFrame:
    """Per series its bars, repeated keys and gaps, and whether it is exactly as long as needed without either."""
    keys = bars.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    own = keys.groupBy(*SERIES).agg(F.sum("n").alias("bars"), F.sum(F.col("n") - 1).alias("duplicates"))
    holes = gaps(keys).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("gaps"))
    rows = own.join(holes, SERIES, "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))
    return rows.withColumn("exact", (F.col("bars") == needed) & (F.col("duplicates") == 0) & (F.col("gaps") == 0))


def until(bars: DataFrame, snapshot_ms: Column) -> DataFrame:
    """Bars closed at a snapshot: what came later cannot be seen."""
    return bars.where(F.col("close_time_ms") <= snapshot_ms)
