"""Facts alive at a time: interval joins on dyadic nodes of a series' bars.

A fact holds for the bars from_i <= i < until_i (null: for good). The bars are cut into nodes of 1, 2, 4, ... bars; a
fact lies in the few nodes that make up its span exactly, a bar in one node of each size, and a fact is alive at a bar
if and only if they share a node - then exactly one. So n bars and m facts meet as equal keys, (n + m) log n rows, and
work is dealt by series and node instead of by series. What is wanted of the facts alive (those that touch a price
interval, the nearest ones) is found inside the nodes, without pairing all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .crossing import asof


def heights(rows: DataFrame) -> int:
    """The number of node sizes that rows' bars (i) need: one number of the whole table."""
    top = rows.agg(F.max("i")).first()[0]
    return max(1, int(top or 0).bit_length())


def on_bars(facts: DataFrame, bars: DataFrame, by: list[str], start: str = "known_at", end: str = "dead_at") -> DataFrame:
    """facts with from_i and until_i: the first bars (i, close_time_ms) that close at or after the times start and end; facts alive at no bar go."""
    rows = facts.withColumn("_a", F.col(start) - 1).withColumn("_b", F.col(end) - 1)
    rows = asof(rows, bars, by, "_a", "close_time_ms", "_from", ["i"])
    rows = asof(rows, bars, by, "_b", "close_time_ms", "_until", ["i"])
    first = lambda c: F.coalesce(F.col(f"{c}.i") + 1, F.lit(0))
    rows = rows.withColumn("from_i", first("_from")).withColumn("until_i", F.when(F.col(end).isNotNull(), first("_until")))
    return rows.where(F.col("until_i").isNull() | (F.col("from_i") < F.col("until_i"))).drop("_a", "_b", "_from", "_until")


def cover(start: Column, end: Column, sizes: int) -> Column:
    """The nodes, as struct(_size, _node), that make up the bars start <= i < end: two of each size at most."""
    end = F.least(F.coalesce(end, F.lit(1 << sizes)), F.lit(1 << sizes)).cast("long")
    start = F.greatest(start, F.lit(0)).cast("long")

    def of_size(s: Column) -> Column:
        unit = F.expr("1L") * F.pow(F.lit(2), s).cast("long")
        a, b = F.ceil(start / unit), F.floor(end / unit)
        node = lambda n: F.struct(s.cast("int").alias("_size"), n.cast("long").alias("_node"))
        return F.array_compact(F.array(F.when((a < b) & (a % 2 == 1), node(a)), F.when((a < b) & (b % 2 == 1), node(b - 1))))

    # no node is larger than the span; one size more, as the logarithm may be rounded down
    top = F.least(F.lit(sizes), F.coalesce(F.floor(F.log2(end - start)).cast("int"), F.lit(0)) + 1)
    return F.flatten(F.transform(F.sequence(F.lit(0), top), of_size))


def around(i: Column, sizes: int) -> Column:
    """The node of each size that bar i lies in."""
    return F.transform(F.sequence(F.lit(0), F.lit(sizes)), lambda s: F.struct(s.cast("int").alias("_size"), F.floor(i / F.pow(F.lit(2), s)).cast("long").alias("_node")))


def dealt(rows: DataFrame, nodes: Column) -> DataFrame:
    return rows.withColumn("_at", F.explode(nodes)).select("*", "_at._size", "_at._node").drop("_at")


def touching(queries: DataFrame, facts: DataFrame, by: list[str], span: tuple[str, str], fact_span: tuple[str, str], sizes: int) -> DataFrame:
    """Pairs of queries (by, i, span) and the facts of the same by alive at i whose interval touches the query's; each pair once.

    Within a node both are dealt by price bins as wide as a series' mean query or mean fact, whichever is wider, so
    that a row lies in few bins and distant prices never meet.
    Rows with a null bound touch nothing. But for by the columns of both must differ.
    """
    spans = lambda rows, s: rows.groupBy(*by).agg(F.avg(F.col(s[1]) - F.col(s[0])).alias("_mean"))
    width = spans(queries, span).unionByName(spans(facts, fact_span)).groupBy(*by).agg(F.coalesce(F.nullif(F.max("_mean"), F.lit(0.0)), F.lit(1.0)).alias("_width"))
    place = lambda c: F.floor(F.col(c) / F.col("_width"))
    binned = lambda rows, s, name: rows.join(width, by).withColumn(name, place(s[0])).withColumn("_bin", F.explode(F.sequence(name, place(s[1])))).drop("_width")
    q = dealt(binned(queries, span, "_l"), around(F.col("i"), sizes))
    f = dealt(binned(facts, fact_span, "_r"), cover(F.col("from_i"), F.col("until_i"), sizes))
    met = q.join(f, [*by, "_size", "_node", "_bin"])
    meet = (F.col(span[0]) <= F.col(fact_span[1])) & (F.col(fact_span[0]) <= F.col(span[1])) & (F.col("_bin") == F.greatest("_l", "_r"))
    return met.where(meet).drop("_size", "_node", "_bin", "_l", "_r")


def nearest(queries: DataFrame, facts: DataFrame, by: list[str], sizes: int, k: int = 3) -> DataFrame:
    """by, i, up and near of queries (by, i, up, edge): the k distinct prices of facts (by, from_i, until_i, price, payload) alive at i that are next above edge (up) or below it, never at it.

    near is an array of struct(price, payload), nearest first, shorter or absent where there are fewer; of facts with one
    price it has the least payload. In each node facts and queries lie in one order of price; a fact carries those
    next beyond it, and a query takes what the last fact before it carries. Nodes without a query are left out before
    that. Queries differ in (by, i, up) and are read twice.
    """
    sides = F.explode(F.array(F.lit(True), F.lit(False)))
    sign = F.when(F.col("up"), 1.0).otherwise(-1.0)
    key = [*by, "up", "_size", "_node"]
    q = dealt(queries.select(*by, "up", "i", (F.col("edge") * sign).alias("_p")), around(F.col("i"), sizes))
    f = dealt(facts.select(*by, "from_i", "until_i", "price", "payload"), cover(F.col("from_i"), F.col("until_i"), sizes)).withColumn("up", sides)
    f = f.join(q.select(*key).distinct(), key, "left_semi")
    f = f.groupBy(*key, (F.col("price") * sign).alias("_p")).agg(F.min(F.struct("price", "payload")).alias("_own"))
    order = Window.partitionBy(*key).orderBy("_p")
    f = f.withColumn("_next", F.collect_list("_own").over(order.rowsBetween(0, k - 1)))
    both = f.select(*key, "_p", F.lit(1).alias("_kind"), F.lit(None).cast(q.schema["i"].dataType).alias("i"), "_next")
    both = both.unionByName(q.select(*key, "_p", F.lit(0).alias("_kind"), "i", F.lit(None).cast(f.schema["_next"].dataType).alias("_next")))
    # from far to near; at one price the query comes first, so that the fact there is not beyond it
    falling = Window.partitionBy(*key).orderBy(F.desc("_p"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_met", F.last("_next", ignorenulls=True).over(falling)).where("_kind = 0 and _met is not null")
    found = both.groupBy(*by, "i", "up").agg(F.flatten(F.collect_list("_met")).alias("_m"))
    near = F.expr("if(up, array_sort(_m), array_sort(_m, (a, b) -> case when a.price > b.price then -1 when a.price < b.price then 1 when a.payload < b.payload then -1 when a.payload > b.payload then 1 else 0 end))")
    found = found.withColumn("_m", near)
    once = F.expr("filter(_m, (x, n) -> n = 0 or x.price <> _m[n - 1].price)")
    return found.select(*by, "i", "up", F.slice(once, 1, k).alias("near"))


def counts(queries: DataFrame, facts: DataFrame, by: list[str], sizes: int, *values: Column) -> DataFrame:
    """by, i and the aggregates values over the facts alive at i of each query (by, i); no row where none is alive.

    Facts are summed up a node first, so values must be sums, counts, least or largest ones of facts' columns, named n_...
    """
    own = dealt(facts, cover(F.col("from_i"), F.col("until_i"), sizes)).groupBy(*by, "_size", "_node").agg(*values)
    names = [c for c in own.columns if c not in (*by, "_size", "_node")]
    merge = lambda c: (F.max if c.startswith("max_") else F.min if c.startswith("min_") else F.sum)(c).alias(c)
    return dealt(queries.select(*by, "i"), around(F.col("i"), sizes)).join(own, [*by, "_size", "_node"]).groupBy(*by, "i").agg(*[merge(c) for c in names])
