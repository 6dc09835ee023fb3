"""Source divergence audit: how far the term shares of each source stray from those of its language and of the other sources."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A language keeps the terms that so many of its documents have.
MIN_DOCS = 3
#: Terms reported of a group.
TOP = 200
SCALE = 1_000_000_000
#: Bytes to terms: letters of ASCII in lower case, other ASCII to blanks, the rest of UTF-8 as it is.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Distinct terms a task sums up before it sends them on, and documents of one term as a part of one number beside its count.
HELD, DOC = 250_000, 1 << 44


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and n_docs of documents (lang, source, text), summed by task; dealt by lang and term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in held.items():
                if terms:
                    both = np.fromiter(terms.values(), np.int64, len(terms))
                    names = pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(list(terms), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([*names, pa.array(both % DOC), pa.array(both // DOC)], names=["lang", "source", "term", "n", "n_docs"])
            held.clear()

        waiting = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = held.setdefault((lang, source), {})
                before = len(terms)
                for term, n in Counter(text.translate(TERMS).split()).items():
                    terms[term] = terms.get(term, 0) + n + DOC
                waiting += len(terms) - before
                if waiting > HELD:
                    yield from sums()
                    waiting = 0
        yield from sums()

    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    summed = rows.mapInArrow(count, "lang string, source string, term string, n bigint, n_docs bigint").repartition("lang", "term")
    return summed.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), exact for counts of up to 18 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    exact = F.lit(SCALE).cast("decimal(10,0)") * wide(n + 1)
    return F.call_function("div", exact, wide(total + kept)) + 1


def strayed(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares have ten digits, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def pair_sums(vectors: DataFrame) -> DataFrame:
    """lang, i, j and value: the sum of m * floor((p_i - p_j)^2 / p_j) over vectors (lang, p, m), for each two places of p.

    p has a share for each source of the language. A block of vectors is a matrix; each pair of its columns is one
    array expression, and each task sends one number a pair and language.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], int] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            shares, sizes, m = batch.column(1), batch.column(1).value_lengths().to_numpy(), batch.column(2).to_numpy()
            for lang in dict.fromkeys(langs):
                own = np.flatnonzero(langs == lang)
                p = shares.take(pa.array(own)).flatten().to_numpy().reshape(len(own), sizes[own[0]]).T.copy()
                times = m[own]
                for j, q in enumerate(p):
                    away = p - q
                    f = away * away // q
                    for i, (high, low) in enumerate(zip((f >> 30) @ times, (f & (1 << 30) - 1) @ times, strict=True)):
                        sums[lang, i, j] = sums.get((lang, i, j), 0) + (int(high) << 30) + int(low)
        from decimal import Decimal

        if sums:
            lang, i, j = zip(*sums, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(x) for x in sums.values()], pa.decimal128(38, 0))], names=["lang", "i", "j", "value"])

    return vectors.mapInArrow(add, "lang string, i int, j int, value decimal(38,0)").groupBy("lang", "i", "j").agg(F.sum("value").cast("long").alias("value"))


def audited(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: of each group (lang, source) its distance from every other source of the language (part pair),
    and the terms it has more of than its language, up to rank top (part term).

    Terms with equal counts in the group and the language have equal values, so values are worked out for cells of
    equal counts, cells of equal value are merged, and only the terms of the cells that reach into the report are
    looked at, in UTF-8 order. For pairs a cell is a set of terms with equal counts in every source. Null text, lang
    and source are empty strings. Groups without a kept term take part; every row counts, repeated ones too; an empty
    table gives no row; other columns, whatever their names, don't matter.
    """
    rows = docs.select(F.coalesce(docs["lang"], F.lit("")).alias("lang"), F.coalesce(docs["source"], F.lit("")).alias("source"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    terms = term_counts(rows).groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts"), F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs"))
    terms = written(terms.where(F.col("n_docs") >= min_docs).drop("n_docs"), "divergence-terms")
    each = terms.select("lang", "term", "lang_n", F.explode("counts").alias("c")).select("lang", "term", "lang_n", "c.*")
    cells = written(each.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("m")), "divergence-cells")

    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    place = Window.partitionBy("lang").orderBy("source")
    groups = written(groups.withColumn("place", F.row_number().over(place) - 1), "divergence-groups")
    return term_part(each, cells, groups, top).unionByName(pair_part(terms, groups))


def term_part(each: DataFrame, cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    group, value = ["lang", "source"], F.col("value")
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    valued = cells.join(groups, group).withColumn("p", p).withColumn("q", q).where("p > q").select(*group, "n", "lang_n", "m", strayed(F.col("p"), F.col("q")).alias("value"))
    falling = Window.partitionBy(*group).orderBy(value.desc())
    values = valued.groupBy(*group, "value").agg(F.sum("m").alias("m")).withColumn("nth", F.row_number().over(falling)).where(F.col("nth") <= top)
    values = values.withColumn("before", F.coalesce(F.sum("m").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < top)
    chosen = valued.join(values.select(*group, "value", "before"), [*group, "value"]).drop("m")
    found = each.join(chosen, [*group, "n", "lang_n"])
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy(*group, "value", "before").orderBy("term"))).where(F.col("nth") <= top)
    rank = F.col("before") + F.col("nth")
    return found.where(rank <= top).select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "value", rank.cast("int").alias("rank"))


def pair_part(terms: DataFrame, groups: DataFrame) -> DataFrame:
    names = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "source", "total"))).alias("sources"), F.first("kept").alias("kept"))
    vectors = terms.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("m")).join(names, "lang")
    n = lambda s: F.coalesce(F.get(F.filter("counts", lambda c: c["source"] == s["source"]), F.lit(0))["n"], F.lit(0))
    vectors = vectors.select("lang", F.transform("sources", lambda s: share(n(s), s["total"], F.col("kept"))).alias("p"), "m")
    own, other = groups.select("lang", "source", F.col("place").alias("i")), groups.select("lang", F.col("source").alias("item"), F.col("place").alias("j"))
    pairs = own.join(other, "lang").where("i <> j").join(pair_sums(vectors), ["lang", "i", "j"], "left").na.fill(0, ["value"])
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
