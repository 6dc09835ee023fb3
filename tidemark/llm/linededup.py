"""Line dedup: three-line windows that stood earlier in the corpus are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, unpacked, whole_row, written

WIDTH = 3


def _own() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.col("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("2"), text).alias("h2")]


def line_windows(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 (the text's hash), k (place of the first line among lines with a word), w1, w2 (the window's hash, 128 bits)."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x, F.lit(BLANKS))), lambda x: x != "")
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("2"), x).alias("b")))

    def windows(p: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(p) - WIDTH), lambda i: F.struct(i.alias("k"), F.xxhash64(*[p[i + j]["a"] for j in range(WIDTH)]).alias("w1"), F.xxhash64(*[p[i + j]["b"] for j in range(WIDTH)]).alias("w2")))
        return F.when(F.size(p) >= WIDTH, each)

    return docs.select(*_own(), F.explode(let(hashed, windows)).alias("_x")).select("doc_id", "h1", "h2", "_x.*")


def later_windows(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 and later: the places of windows that an earlier place of the corpus has too, sorted.

    Earlier: smaller doc_id (null first), then the text's hash, then the place in the document.
    """
    windows = line_windows(docs)
    place = F.struct("doc_id", "h1", "h2", "k")
    first = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    first = written(first, "linededup")  # so that both sides of the join are dealt anew and hot windows can be split
    later = windows.join(first, ["w1", "w2"]).where(place != F.col("first"))
    return later.groupBy("doc_id", "h1", "h2").agg(F.sort_array(F.collect_set("k")).alias("later"))


def _cut(docs: DataFrame) -> DataFrame:
    """row, left (the text that stays), n_lines and n_removed."""
    own = docs.select(whole_row(docs), *[c.alias(n) for c, n in zip(_own(), ("id", "h1", "h2"), strict=True)])
    later = later_windows(docs).select(F.col("doc_id").alias("l_id"), F.col("h1").alias("l1"), F.col("h2").alias("l2"), "later")
    rows = own.join(later, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("h1") == F.col("l1")) & (F.col("h2") == F.col("l2")), "left")
    covered = F.array_distinct(F.flatten(F.transform("later", lambda k: F.array(*[k + j for j in range(WIDTH)]))))

    def parts(x: Column) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.translate(x[i], BLANKS, "") != "")

        def cut(at: Column) -> Column:
            gone = F.transform(covered, lambda k: at[k])
            left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: x[i])
            hit = F.col("later").isNotNull()
            return F.struct(F.when(hit, F.array_join(left, "\n")).alias("t"), F.size(at).cast("long").alias("n"), F.when(hit, F.size(gone)).otherwise(0).cast("long").alias("r"))

        return let(full, cut)

    rows = rows.withColumn("p", let(F.split(F.coalesce("row.text", F.lit("")), "\n"), parts))
    text = F.when(F.col("later").isNull(), F.col("row.text")).otherwise(F.col("p.t"))
    return rows.select("row", text.alias("left"), F.col("p.n").alias("n_lines"), F.col("p.r").alias("n_removed"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with text cut, and n_lines (lines with a word) and n_removed; columns of docs with these two names give way.

    Lines are trimmed for comparison; blank lines don't count and stay. A window of three consecutive lines
    with a word that stands at an earlier place too is covered; covered lines, overlaps merged, are removed.
    Every removed line so has an equal line at an earlier place, and the earliest of these stays. Documents with
    fewer than three such lines have no window and stay as they are; null texts stay null; rows with equal doc_id
    and text are one document and are treated alike; other columns are kept, whatever their names.
    """
    told = ("n_lines", "n_removed")
    columns = [c for c, name in zip(unpacked(docs), docs.columns, strict=True) if name not in told]
    columns = [F.col("left").alias("text") if name == "text" else c for c, name in zip(columns, [n for n in docs.columns if n not in told], strict=True)]
    return _cut(docs).select(*columns, *told)


def without_repeats(docs: DataFrame) -> DataFrame:
    """As deduplicated(), with the columns of docs only and all of them; n_chars, if there, counts what is left."""
    return _cut(docs).select(*unpacked(docs, text=F.col("left")))
