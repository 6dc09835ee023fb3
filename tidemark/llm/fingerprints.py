"""Document fingerprints from closed syncmers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, partitions

#: Tokens: words, cut every 16 characters so that texts without blanks have tokens too.
TOKEN = r"[^\x20\x09-\x0D]{1,16}"
#: Tokens in an anchor and in the substrings whose smallest must lie at an edge of it; values in a fingerprint.
K, S, VALUES = 5, 2, 128
HEX = 10


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def anchors(w: Column, k: int = K, s: int = S) -> Column:
    """Closed syncmers of the token array w: array of (pos, hash) in order.

    A k-mer is chosen if the smallest of its s-mers, by MD5, is its first or its last one. The choice depends on
    nothing outside of the k-mer, so a passage has the same anchors wherever it stands. Should none be chosen,
    or w be shorter than k, all of w is one anchor at 0; no tokens, no anchors.
    """

    def chosen(m: Column) -> Column:
        def edge(i: Column) -> Column:
            least = F.array_min(F.slice(m, i + 1, k - s + 1))
            return (m[i] == least) | (m[i + k - s] == least)

        at = F.filter(F.sequence(F.lit(0), F.size(w) - k), edge)
        return F.transform(at, lambda i: F.struct(i.alias("pos"), F.md5(F.concat_ws(" ", F.slice(w, i + 1, k))).alias("hash")))

    smers = F.transform(F.sequence(F.lit(0), F.size(w) - s), lambda i: F.md5(F.concat_ws(" ", *[w[i + j] for j in range(s)])))
    found = F.when(F.size(w) >= k, let(smers, chosen)).otherwise(F.array().cast("array<struct<pos:int,hash:string>>"))
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.md5(F.concat_ws(" ", w)).alias("hash")))
    return F.when(F.size(w) == 0, F.array().cast("array<struct<pos:int,hash:string>>")).otherwise(let(found, lambda a: F.when(F.size(a) == 0, whole).otherwise(a)))


def document_anchors(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """doc_id, pos (token number) and hash of every anchor, for positional matching."""
    found = let(tokens(F.col("text")), lambda w: anchors(w, k, s))
    return docs.select("doc_id", F.explode(found).alias("_a")).select("doc_id", "_a.pos", "_a.hash")


def sketch(text: Column, k: int = K, s: int = S, values: int = VALUES) -> Column:
    """The smallest distinct anchor hashes (40 bits), sorted: a fixed-size sample of all of them, the same for equal texts."""
    hashes = let(tokens(text), lambda w: F.transform(anchors(w, k, s), lambda a: F.substring(a["hash"], 1, HEX)))
    least = F.slice(F.sort_array(F.array_distinct(hashes)), 1, values)
    return F.transform(least, lambda x: F.conv(x, 16, 10).cast("long"))


def likeness(a: Column, b: Column, values: int = VALUES) -> Column:
    """Estimated Jaccard similarity of two anchor sets from their sketches, exact for small sets; 1 if both are empty."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, values)
    both = let(union, lambda u: F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.greatest(F.size(u), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both.cast("double"))


def text_of(sketched: Column) -> Column:
    return F.array_join(F.transform(sketched, lambda x: F.lower(F.lpad(F.hex(x), HEX, "0"))), "")


def bucket_of(key: str, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above key, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    array = "array(" + ", ".join(f"{b}L" for b in bounds) + ")"
    search = f"(c, i) -> if(c.lo >= c.hi, c, if(get({array}, (c.lo + c.hi) div 2) <= x, named_struct('lo', cast((c.lo + c.hi) div 2 + 1 as int), 'hi', c.hi), named_struct('lo', c.lo, 'hi', cast((c.lo + c.hi) div 2 as int))))"
    return F.expr(f"transform(array({key}), x -> aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(bounds)}), {search}, c -> c.lo))[0]")


def in_ranges(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in ranges _part of doc_id, in each ordered by _guard, _key, _h1, _h2.

    For what looks at the next document (after the last comes the first). Documents are dealt by ranges of doc_id; each range also gets the first document of the following one, so that
    no task orders all rows; rows with _guard = 1 are such copies. Null doc_ids come first; equal ones are ordered by the text's hash.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("_key", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("_h1", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_h2", F.xxhash64(F.lit("2"), F.coalesce("text", F.lit(""))))
    n = partitions(spark)
    cuts = docs.where("doc_id is not null").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    rows = rows.withColumn("_part", bucket_of("_key", sorted({int(c) for c in cuts})))
    starts = rows.groupBy("_part").agg(F.min("_key").alias("_start"))
    firsts = rows.join(F.broadcast(starts), "_part").where(F.col("_key") == F.col("_start")).withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_h1", "_h2"))).where("_rank = 1")
    order = [r["_part"] for r in starts.select("_part").orderBy("_part").collect()]  # one number a range
    back = {p: order[i - 1] for i, p in enumerate(order)}
    to = F.create_map(*[F.lit(x) for kv in back.items() for x in kv]) if back else F.create_map(F.lit(0), F.lit(0))
    guards = firsts.withColumn("_part", to[F.col("_part")]).select(*rows.columns, F.lit(1).alias("_guard"))
    return rows.withColumn("_guard", F.lit(0)).unionByName(guards)


def fingerprinted(docs: DataFrame, k: int = K, s: int = S, values: int = VALUES) -> DataFrame:
    """Contract columns for documents.

    Null text: empty. The edited text takes the first floor(n_chars / 4) code points of the next document (all, if
    it has fewer). Empty texts have an empty fingerprint, like each other and unlike all others. Repeated rows are
    documents like others. Other columns don't matter; an empty table stays empty.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = in_ranges(plain).withColumn("_sketch", sketch(F.col("text"), k, s, values))
    w = Window.partitionBy("_part").orderBy("_guard", "_key", "_h1", "_h2")
    rows = rows.withColumn("_next", F.lead("text").over(w)).withColumn("_next_sketch", F.lead("_sketch").over(w)).where("_guard = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars as int) - _cut)"), F.expr("substring(_next, 1, _cut)"))
    rows = rows.select("doc_id", "n_chars", "_sketch", "_next_sketch", edited.alias("_edited"))
    rows = rows.withColumn("_edited_sketch", sketch(F.col("_edited"), k, s, values)).withColumn("edited_sha256", F.sha2(F.col("_edited"), 256))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("_sketch")).alias("fingerprint"), text_of(F.col("_edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("_sketch"), F.col("_edited_sketch"), values).alias("near_edited"), likeness(F.col("_sketch"), F.col("_next_sketch"), values).alias("near_next"),
    )
