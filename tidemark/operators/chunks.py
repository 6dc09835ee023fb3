"""Windows over long series, dealt by chunks of a series instead of by series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import SERIES, TIMEFRAMES
from .shared import kept

#: Bars in a chunk: what one task sorts at once. A series of 10^7 bars makes 153 chunks.
CHUNK = 65_536


def joined(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of `others` that have the same series and keys. Bars without a symbol are series too, as in windows, so nulls meet."""
    theirs = others.withColumnRenamed("symbol", "_symbol")
    same = F.col("symbol").eqNullSafe(F.col("_symbol"))
    for k in ["timeframe", *keys]:
        theirs = theirs.withColumnRenamed(k, f"_other_{k}")
        same = same & (F.col(k) == F.col(f"_other_{k}"))
    return rows.join(theirs, same).drop("_symbol", *[f"_other_{k}" for k in ["timeframe", *keys]])


def numbered(bars: DataFrame, size: int | None = None) -> DataFrame:
    """bars with i, their number in the series from 0 by open_time_ms; computed once and stored.

    A chunk is a span of time that holds at most `size` bars of a timeframe. Bars are numbered inside theirs; how many came
    before it is a running sum of one row a chunk. Repeated times get numbers of their own, in no fixed order.
    """
    length = F.coalesce(F.create_map(*[F.lit(x) for kv in TIMEFRAMES.items() for x in kv])[F.col("timeframe")], F.lit(60_000))
    chunk = F.floor(F.col("open_time_ms") / (length.cast("long") * (size or CHUNK)))
    own = Window.partitionBy(*SERIES, "_chunk").orderBy("open_time_ms")
    rows = kept(bars.withColumn("_chunk", chunk).withColumn("_n", F.row_number().over(own)))
    earlier = Window.partitionBy(*SERIES).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*SERIES, "_chunk").agg(F.max("_n").alias("_count")).select(*SERIES, "_chunk", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_before"))
    return joined(rows, counts, ["_chunk"]).select(*bars.columns, (F.col("_n") - 1 + F.col("_before")).cast("int").alias("i"))


def with_halo(bars: DataFrame, before: int = 0, after: int = 0, size: int | None = None) -> DataFrame:
    """bars with _chunk and _own: every bar in its chunk, and copies of it (_own false) in the chunks whose bars look up to `before` bars back or `after` ahead at it.

    So a window over inside() whose frame stays within these bounds sees all its bars; rows that are not _own go afterwards.
    """
    size = size or CHUNK
    at = lambda i: F.floor(i / size).cast("int")
    reached = F.sequence(at(F.greatest(F.col("i") - after, F.lit(0))), at(F.col("i") + before))
    return bars.withColumn("_chunk", F.explode(reached)).withColumn("_own", F.col("_chunk") == at(F.col("i")))


def inside() -> Window:
    """The window over a chunk in order."""
    return Window.partitionBy(*SERIES, "_chunk").orderBy("i")


def own(rows: DataFrame) -> DataFrame:
    """Rows of with_halo() without the copies."""
    return rows.where("_own").drop("_own", "_chunk")


def so_far(rows: DataFrame, values: dict[str, tuple[str, Column]], index: str = "i", ahead: bool = False, size: int | None = None) -> DataFrame:
    """rows with, for each name, the min, max or last value that is not null of an expression over all rows before (ahead: after) it in its series.

    The frame is unbounded, so chunks hand on what they end with: one row a chunk, met in a window of its own and joined
    back. rows are read twice.
    """
    size = size or CHUNK
    last = F.desc(index) if ahead else F.asc(index)
    over = {"min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    both = {"min": F.least, "max": F.greatest, "last": F.coalesce}
    rank = -F.col(index) if ahead else F.col(index)
    whole = {"min": lambda c: F.min(c), "max": lambda c: F.max(c), "last": lambda c: F.max_by(c, F.when(c.isNotNull(), rank))}
    dealt = rows.withColumn("_chunk", F.floor(F.col(index) / size).cast("int"))
    before = Window.partitionBy(*SERIES, "_chunk").orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy(*SERIES, "_chunk").agg(*[whole[how](value).alias(name) for name, (how, value) in values.items()])
    earlier = Window.partitionBy(*SERIES).orderBy(F.desc("_chunk") if ahead else F.asc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*SERIES, "_chunk", *[over[how](F.col(name)).over(earlier).alias(f"_carried_{name}") for name, (how, _) in values.items()])
    seen = dealt.select("*", *[over[how](value).over(before).alias(f"_seen_{name}") for name, (how, value) in values.items()])
    met = joined(seen, carried, ["_chunk"])
    return met.select(*rows.columns, *[both[how](f"_seen_{name}", f"_carried_{name}").alias(name) for name, (how, _) in values.items()])
