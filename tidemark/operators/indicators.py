"""Average true range and average volume."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import SERIES
from .chunks import inside, own, with_halo

#: Bars in a chunk of the recursion.
CHUNK = 256


def atr(bars: DataFrame, period: int = 14, column: str = "atr") -> DataFrame:
    """bars with the Wilder average true range: the mean of the first `period` ranges, then (last * (period - 1) + range) / period.

    The recursion is a decaying sum. Series are cut into chunks, each summed by windows of its own; only the value
    that a chunk hands on, one row in CHUNK bars, is folded in order by an Arrow function. Null before period - 1.
    """
    q = (period - 1) / period
    last = F.lag("close").over(inside())
    reach = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))
    rows = with_halo(bars, before=period).withColumn("_tr", reach)
    seed = F.avg("_tr").over(inside().rowsBetween(-(period - 1), 0))
    rows = own(rows.withColumn("_seed", F.when(F.col("i") == period - 1, seed)))
    rows = rows.withColumn("_j", F.col("i") - period).withColumn("_c", F.when(F.col("i") >= period, (F.col("_j") / CHUNK).cast("int")).otherwise(-1))
    k = F.col("_j") - F.col("_c") * CHUNK
    weighted = F.col("_tr") / period * F.pow(F.lit(q), -(k + 1))
    part = Window.partitionBy(*SERIES, "_c").orderBy("i")
    rows = rows.withColumn("_sum", F.when(F.col("_c") >= 0, F.sum(weighted).over(part) * F.pow(F.lit(q), k + 1)))
    ends = rows.groupBy(*SERIES, "_c").agg(F.max_by("_sum", "i").alias("last"), F.count(F.lit(1)).alias("n"), F.avg("_tr").alias("seed"))

    def carry(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values("_c")
        value, out = None, []
        for c, end, n, seed in zip(chunks["_c"], chunks["last"], chunks["n"], chunks["seed"], strict=True):
            out.append(value)
            value = (seed if n == period else None) if c < 0 else None if value is None else value * q**n + end
        return chunks[[*SERIES, "_c"]].assign(carried=pd.Series(out, index=chunks.index, dtype="float64"))

    carried = ends.groupBy(*SERIES).applyInPandas(carry, "symbol string, timeframe string, _c int, carried double")
    rows = rows.join(carried, [*SERIES, "_c"])
    value = F.when(F.col("i") == period - 1, F.col("_seed")).when(F.col("i") >= period, F.col("carried") * F.pow(F.lit(q), k + 1) + F.col("_sum"))
    return rows.withColumn(column, value).drop("_tr", "_j", "_c", "_sum", "_seed", "carried")


def average_volume(bars: DataFrame, period: int = 20, column: str = "average_volume") -> DataFrame:
    """bars with the mean volume of the last `period` bars, null before period - 1."""
    last = inside().rowsBetween(-(period - 1), 0)
    return own(with_halo(bars, before=period - 1).withColumn(column, F.when(F.col("i") >= period - 1, F.avg("volume").over(last))))
