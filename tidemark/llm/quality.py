"""Quality rules: per-document measures and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, kept_where, let, unpacked, whole_row, written

#: A line is boilerplate of its host if more documents than both have it.
MIN_DOCS, MAX_SHARE = 10, 0.02
#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.3
SYMBOLS = "#*$%&|<>"
#: What separates words.
SPACE = r"[\x20\x09-\x0D]+"


def with_repeats(rows: DataFrame) -> DataFrame:
    """rows (with _w, an array of words) and n_repeat_words: words within 3-word windows that occur twice or more, the first included.

    Windows are sorted as (64-bit hash, place), so equal ones are neighbours however long the text is. Their places,
    sorted, cover 3 words each, overlaps once.
    Columns are used several times below on purpose: Spark then computes each once and doesn't inline it.
    """
    rows = rows.withColumn("_s", F.expr("sort_array(if(size(_w) < 4, cast(array() as array<struct<h:bigint,i:int>>), transform(sequence(0, size(_w) - 3), i -> named_struct('h', xxhash64(_w[i], _w[i + 1], _w[i + 2]), 'i', i))))"))
    rows = rows.withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, i) -> (i > 0 and get(_s, i - 1).h = x.h) or get(_s, i + 1).h = x.h), x -> x.i))"))
    return rows.withColumn("n_repeat_words", F.expr("aggregate(transform(_p, (x, i) -> least(3, coalesce(get(_p, i + 1), x + 3) - x)), 0L, (a, b) -> a + b)")).drop("_s", "_p")


def measured(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns kept, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of rows with a text; null text: no words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    symbols = F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))
    rows = rows.select(*keep, symbols.cast("long").alias("n_symbols"), dup.cast("long").alias("n_dup_lines"), F.array_remove(F.split(text, SPACE), "").alias("_w"))
    rows = with_repeats(rows).withColumn("n_words", F.size("_w").cast("long")).withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long")).drop("_w")
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal(line: Column) -> Column:
    """A line with A-Z in lower case, white space collapsed to single blanks and none at its ends."""
    return F.trim(F.regexp_replace(lower_ascii(line), SPACE, " "))


def host_of(source: str = "source") -> Column:
    """Null sources are a host of their own, named by the empty string."""
    return F.coalesce(source, F.lit(""))


def line_hashes(text: Column) -> Column:
    """The hashes of a text's normalised lines with a word, in order."""
    clean = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normal)
    return F.transform(F.filter(clean, lambda x: x != ""), lambda x: F.xxhash64(x))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """host and frequent, the hashes of its lines that more than min_docs documents and more than max_share of its documents have.

    A document counts once for each line it has; every row is a document. A host has fewer than 1 / max_share times
    its mean number of lines of these, whatever its size. Counts are partial before they are dealt, so that neither
    a hot host nor a hot line meets in one task.
    """
    hosts = docs.groupBy(host_of().alias("host")).agg(F.count(F.lit(1)).alias("host_docs"))
    lines = docs.select(host_of().alias("host"), F.explode(F.array_distinct(line_hashes(F.col("text")))).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > min_docs)
    above = counts.join(hosts, "host").where(F.col("n_docs") > max_share * F.col("host_docs"))
    return written(above.groupBy("host").agg(F.collect_list("line").alias("frequent")), "quality")


def weighed(docs: DataFrame, min_left: float, min_docs: int, max_share: float) -> DataFrame:
    """row, the base measures, hit (hashes of the document's lines above the limits), n_cut (their words) and kept."""
    rows = docs.select(whole_row(docs), host_of().alias("host"), "text")
    rows = rows.join(frequent_lines(docs, min_docs, max_share), "host", "left")
    rows = rows.withColumn("hit", F.when(F.col("frequent").isNull(), F.array().cast("array<bigint>")).otherwise(F.array_intersect(line_hashes(F.col("text")), F.col("frequent"))))
    cut = F.filter(F.transform(F.split(F.col("text"), "\n"), normal), lambda x: F.array_contains("hit", F.xxhash64(x)))
    words = F.aggregate(cut, F.lit(0).cast("long"), lambda n, x: n + F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1)
    rows = rows.withColumn("n_cut", F.when(F.size("hit") > 0, words).otherwise(F.lit(0).cast("long")))
    rows = measured(rows, "row", "hit", "n_cut")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_cut") >= min_left * F.col("n_words")))


def judged(docs: DataFrame, min_left: float = MIN_LEFT, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Contract columns for documents, n_cut (words in removed lines) and kept.

    Null text: no words, so base_failed; null source: a host of its own; every row is a document, repeated ones and
    copies too; an empty table stays empty; other columns, whatever their names, don't matter. A document is
    rejected as depleted when less than min_left of its words stand outside of lines above the limits.
    """
    rows = weighed(docs, min_left, min_docs, max_share)
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_cut")


def filtered(docs: DataFrame, min_left: float = MIN_LEFT, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """The documents that are kept, without their lines above the limits; n_chars, if there, counts what is left. Columns as in docs, as judged()."""
    rows = kept_where(weighed(docs, min_left, min_docs, max_share), F.col("kept"))
    own = F.col("row.text")
    left = F.array_join(F.filter(F.split(own, "\n"), lambda x: ~F.array_contains("hit", F.xxhash64(normal(x)))), "\n")
    rows = rows.select("row", F.when(F.size("hit") > 0, left).otherwise(own).alias("left"))
    return rows.select(*unpacked(docs, text=F.col("left")))
