"""Jaccard join on word n-grams: prefix filters under several global token orders, then exact verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, perhaps_in, unpacked, whole_row, written

GRAM, PERCENT = 4, 85
#: Share of its tokens that a document's prefix has over the shortest one: partners must share so many more tokens in it.
#: Used on all documents; of those that pass, all tokens are counted.
SLACK = 0.1
#: Times that a document's family is replaced by its family's; any number gives the same result.
JUMPS = 3
#: Levels of families inside of families; any number gives the same result.
LEVELS = 6
#: Inner families up to this size are compared pair by pair, at most half as many pairs as this a member.
SMALL = 32


def shingles(text: Column, gram: int = GRAM) -> Column:
    """The sorted distinct hashes (64 bits) of a text's n-word sequences, A-Z in lower case; with fewer words all of them are one; none without words."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    each = F.transform(F.array(w), lambda w: F.when(F.size(w) >= gram, F.transform(F.sequence(F.lit(0), F.size(w) - gram), lambda i: F.xxhash64(*[w[i + j] for j in range(gram)]))).when(F.size(w) > 0, F.array(F.xxhash64(F.lit(gram), F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>")))[0]
    return F.sort_array(F.array_distinct(each))


def least(n: Column, percent: int) -> Column:
    """How many tokens a partner must share with a set of n at least."""
    return F.floor((n * percent + 99) / 100)


def extra(n: Column, slack: float) -> Column:
    return F.greatest(F.lit(1), F.floor(n * slack)).cast("int")


def prefix(tokens: Column, percent: int, slack: float) -> Column:
    """The first tokens of a set in an order, so many that linked sets share `extra` (of the smaller one) within their prefixes."""
    n = F.size(tokens)
    return F.slice(tokens, 1, F.least(n, (n - least(n, percent)).cast("int") + extra(n, slack)))


def needed(n: Column, percent: int, slack: float) -> Column:
    """How many prefix tokens a set of n shares with any partner: the smallest partner counts."""
    return extra(least(n, percent), slack)


def other_prefixes(tokens: Column, length: Column) -> list[Column]:
    """The first tokens of a set under two more orders, independent of each other and of the tokens themselves: second and third."""
    order = lambda name: F.slice(F.sort_array(F.transform(tokens, lambda t: F.xxhash64(t, F.lit(name)))), F.lit(1), length.cast("int")).alias(name)
    return [order("second"), order("third")]


def several(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tokens of rows (uid, tokens), one a row, and t and c of those that more than one row has."""
    tokens = rows.select("uid", F.explode("tokens").alias("t"))
    # written, so that both sides of a join are dealt anew and frequent tokens can be split
    return tokens, written(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "ngram-counts")


def sharing(rows: DataFrame, need: Column) -> DataFrame:
    """uid of the rows (uid, n, tokens) that share at least `need` of their tokens with others."""
    tokens, counts = several(rows)
    found = tokens.join(counts.select("t"), "t").groupBy("uid").agg(F.count(F.lit(1)).alias("s"))
    return rows.select("uid", "n").join(found, "uid").where(F.col("s") >= need).select("uid")


def with_shared(rows: DataFrame, need: Column) -> DataFrame:
    """uid, n and shared (tokens that others have too, rarest first) of the rows (uid, n, tokens) that share at least `need` of these."""
    tokens, counts = several(rows)
    found = tokens.join(counts, "t").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("s"))
    found = rows.select("uid", "n").join(found, "uid").where(F.size("s") >= need)
    return found.select("uid", "n", F.transform("s", lambda x: x["t"]).alias("shared"))


def components(links: DataFrame, name: str) -> DataFrame:
    """node and label, the smallest node of its component, of links (a, b). Labels are halved along their paths each round."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}-labels")
    while True:
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(around, labels.node == around.a).select("node", "label", F.least("label", "m").alias("low"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("to"))
        lower = lower.join(jump, lower.low == jump["at"], "left").select("node", F.col("label").alias("was"), F.least("low", "to").alias("label"))
        lower = written(lower, f"{name}-labels")
        labels = lower.select("node", "label")
        if lower.where("was <> label").isEmpty():
            return labels


def families(buckets: DataFrame) -> DataFrame:
    """uid and family of buckets (t, uid): each set follows the first, by a hash, of all that it shares a bucket with, and that one in turn.

    Near copies of one set so come together. Families only bring sets near that are cheap to compare; no result hangs on them.
    """
    rank = F.struct(F.xxhash64("uid").alias("rank"), "uid")
    first = buckets.groupBy("t").agg(F.min(rank).alias("v"))
    follows = buckets.join(first, "t").groupBy("uid").agg(F.min("v").alias("v")).select("uid", F.col("v.uid").alias("family"))
    follows = written(follows, "ngram-follows")
    for _ in range(JUMPS):
        onward = follows.select(F.col("uid").alias("family"), F.col("family").alias("next"))
        follows = written(follows.join(onward, "family").select("uid", F.col("next").alias("family")), "ngram-follows")
    return follows


def centred(members: DataFrame, percent: int) -> DataFrame:
    """uid, family, d and w of members (uid, family, n, shared).

    A family's centre holds the tokens that more than half of its members have; d are the tokens in which a set
    differs from it. With H differing tokens, x and y are linked when (100 + p) H <= (100 - p) (n_x + n_y), and
    H = |d_x| + |d_y| - 2 |d_x & d_y|. So with w = (100 + p) |d| - (100 - p) n they are when
    w_x + w_y <= 2 (100 + p) |d_x & d_y|: near copies are told by the little in which they differ.
    Tokens that no other set has lie in no d but count in w.
    """
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    common = members.select("family", F.explode("shared").alias("t")).groupBy("family", "t").agg(F.count(F.lit(1)).alias("c"))
    centres = common.join(sizes, "family").where("2 * c > size").groupBy("family").agg(F.collect_list("t").alias("centre"))
    rows = members.join(written(centres, "ngram-centres"), "family", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<bigint>")))
    rows = rows.withColumn("d", F.concat(F.array_except("shared", "centre"), F.array_except("centre", "shared")))
    w = F.lit(2 * percent) * F.col("n") + F.lit(100 + percent) * (F.size("d") - F.size("shared"))
    return written(rows.select("uid", "family", w.cast("long").alias("w"), "d"), "ngram-centred")


def confirmed(pairs: DataFrame, sets: DataFrame, unit: int) -> DataFrame:
    """Those of pairs (a, b) that are linked, for sets (uid, w, tokens, length): w_a + w_b <= unit * tokens in both.

    The pairs met in the first order's prefixes; of them only those whose prefixes of `length` tokens meet under
    the second and under the third order as well are left before any set is joined in.
    """
    pairs = written(pairs.distinct(), "ngram-pairs")
    there = written(sets.join(pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct(), "uid"), "ngram-there")
    starts = there.select("uid", *other_prefixes(F.col("tokens"), F.col("length")))
    one = starts.select(F.col("uid").alias("a"), F.col("second").alias("a2"), F.col("third").alias("a3"))
    both = pairs.join(one, "a").join(starts.withColumnRenamed("uid", "b"), "b").where(F.arrays_overlap("a2", "second") & F.arrays_overlap("a3", "third")).select("a", "b")
    left = there.select(F.col("uid").alias("a"), F.col("w").alias("v"), F.col("tokens").alias("x"))
    full = written(both, "ngram-met").join(left, "a").join(there.select(F.col("uid").alias("b"), "w", "tokens"), "b")
    return full.where(F.col("v") + F.col("w") <= unit * F.size(F.array_intersect("x", "tokens"))).select("a", "b")


def near_centres(members: DataFrame, percent: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """One level of within_families(): links (a, b), and the members (uid, family, n, shared) whose links with each other are still to be told."""
    unit = 2 * (100 + percent)
    rows = centred(members, percent)
    least_w = rows.groupBy("family").agg(F.min(F.struct("w", "uid")).alias("v")).select("family", F.col("v.w").alias("least"), F.col("v.uid").alias("main"))
    rows = rows.join(written(least_w, "ngram-main"), "family").withColumn("outer", (F.col("uid") != F.col("main")) & (F.col("w") + F.col("least") > 0))
    rows = rows.withColumn("label", F.when(F.col("outer"), F.col("uid")).otherwise(F.col("main")))
    stars = rows.where(~F.col("outer") & (F.col("uid") != F.col("main"))).select(F.col("uid").alias("a"), F.col("main").alias("b"))
    outside = rows.where("outer").groupBy("family").agg(F.min("w").alias("least_outer"))
    rows = rows.join(written(outside, "ngram-outer"), "family")
    need = F.greatest(F.lit(1), F.ceil((F.col("w") + F.when(F.col("outer"), F.col("least")).otherwise(F.col("least_outer"))) / unit)).cast("int")
    rows = written(rows.where(F.size("d") >= need).select("uid", "family", "w", "label", "outer", need.alias("need"), "d"), "ngram-open")
    tokens = rows.select("uid", "family", F.explode("d").alias("t"))
    counts = written(tokens.groupBy("family", "t").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "ngram-counts")
    d = tokens.join(counts, ["family", "t"]).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("d"))
    rows = rows.drop("d").join(d, "uid").where(F.size("d") >= F.col("need")).withColumn("d", F.transform("d", lambda x: x["t"]))
    rows = written(rows.withColumn("length", F.size("d") - F.col("need") + 1), "ngram-open")
    buckets = rows.select("uid", "family", "w", "label", "outer", F.size("d").alias("s"), F.posexplode(F.expr("slice(d, 1, length)")).alias("k", "t"))
    buckets = of_several_labels(buckets)
    rest = None
    far = buckets.where("outer").select(F.xxhash64("family", "t").alias("t"), "uid")
    if not last and not far.isEmpty():
        own = families(far).withColumnRenamed("family", "own")
        together = own.groupBy("own").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > SMALL).select("own")
        own = written(own.join(together, "own"), "ngram-own")
        rest = written(members.drop("family").join(own.withColumnRenamed("own", "family"), "uid"), "ngram-rest")
        buckets = of_several_labels(buckets.join(own, "uid", "left").withColumn("label", F.coalesce("own", "label")).drop("own"))
    others = buckets.select("family", "t", F.col("uid").alias("b"), F.col("w").alias("bw"), F.col("label").alias("bl"), (F.col("s") - F.col("k")).alias("left"))
    enough = unit * F.least(F.col("s") - F.col("k"), F.col("left")) >= F.col("w") + F.col("bw")
    pairs = buckets.join(others, ["family", "t"]).where((F.col("uid") < F.col("b")) & (F.col("label") != F.col("bl")) & enough).select(F.col("uid").alias("a"), "b")
    found = confirmed(pairs, rows.select("uid", "w", F.col("d").alias("tokens"), "length"), unit)
    return written(stars.unionByName(found), "ngram-inside"), rest


def of_several_labels(buckets: DataFrame) -> DataFrame:
    """Those of buckets (family, t, label, ...) whose rows have different labels."""
    mixed = buckets.groupBy("family", "t").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("family", "t")
    return written(buckets.join(written(mixed, "ngram-mixed"), ["family", "t"], "left_semi"), "ngram-buckets")


def within_families(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span the same components as all links inside of families, of members (uid, family, n, shared).

    Pairs with w_x + w_y <= 0 need not share any token of d. The member with the least w is linked with all that are in
    such a pair, so links with that one say as much as all of them. Every other pair has a member that is not linked
    with it, an outer one, and must share tokens of d: enough of them to lie in prefixes, rarest first, and enough from
    the first one on. Outer members that meet in a prefix form families of their own with centres of their own, and so
    on: only pairs of different ones, or inside of SMALL ones, are compared. After LEVELS the rest are.
    """
    links, level = None, 0
    while links is None or not (members is None or members.isEmpty()):
        level += 1
        found, members = near_centres(members, percent, level == LEVELS)
        links = found if links is None else links.unionByName(found)
    return links


def between_families(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links (a, b) of sets (uid, n, tokens, least) that share a bucket and are of different families; buckets (t, uid, family, n, s, k)."""
    sizes = buckets.groupBy("t", "family").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("t").agg(F.max(F.struct("c", "family")).alias("v"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    largest = written(largest.select("t", F.col("v.family").alias("main")), "ngram-largest")
    mixed = written(buckets.join(largest, "t"), "ngram-mixed")  # pairs of the largest family's members are none of these
    minor = mixed.where("family <> main").select("t", F.col("uid").alias("b"), F.col("family").alias("bf"), F.col("n").alias("m"), (F.col("s") - F.col("k")).alias("left"))
    enough = (100 + percent) * F.least(F.col("s") - F.col("k"), F.col("left")) >= percent * (F.col("n") + F.col("m"))
    once = (F.col("family") == F.col("main")) | (F.col("uid") < F.col("b"))
    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    pairs = mixed.join(minor, "t").where((F.col("family") != F.col("bf")) & once & fits & enough).select(F.least("uid", "b").alias("a"), F.greatest("uid", "b").alias("b"))
    length = F.size("tokens") - F.col("least") + 1
    return confirmed(pairs, sets.select("uid", (2 * percent * F.col("n")).cast("long").alias("w"), "tokens", length.alias("length")), 2 * (100 + percent))


def linked(sets: DataFrame, percent: int) -> DataFrame:
    """node and label of the components of different sets (uid, n, tokens sorted by hash), for those with a partner.

    Orders: the hash (its prefixes must share enough), then rarity among the tokens that several sets have (partners
    meet in one of the rarest, which names the candidates, and may be no nearer the ends of their sets than what they
    must share), then two more hashes (prefixes must meet under both), then all tokens. Near copies of one set aren't
    compared with each other but with what most of them have, those far from that in families of their own.
    """
    shared = with_shared(sets, least(F.col("n"), percent)).withColumn("least", least(F.col("n"), percent).cast("int"))
    shared = written(shared.withColumn("s", F.size("shared")), "ngram-shared")
    rare = shared.select("uid", "n", "s", F.posexplode(F.expr("slice(shared, 1, s - least + 1)")).alias("k", "t"))
    met = written(rare.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("t"), "ngram-several")
    buckets = written(rare.join(met, "t"), "ngram-buckets")
    family = families(buckets.select("t", "uid"))
    members = shared.join(family, "uid")
    inside = within_families(members.select("uid", "family", "n", "shared"), percent)
    across = between_families(buckets.join(family, "uid"), members.select("uid", "n", F.col("shared").alias("tokens"), "least"), percent)
    return components(written(inside.unionByName(across), "ngram-links"), "ngram")


def identified(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns given, doc_id and h1, h2 (the text's hash), by which a document is told."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*columns, "doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("2"), text).alias("h2"))


def clustered(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, h1, h2 (the text's hash), n_shingles and component_id of every document.

    Documents are linked when their shingle sets' Jaccard similarity is percent / 100 at least; component_id is
    the smallest doc_id reachable by links, its own included. Null texts and texts without words have empty sets
    and no links, not even with each other. Null doc_ids take part; a component of these alone has a null id.
    Rows repeated are copies like others. Other columns, whatever their names, don't matter; an empty table stays
    empty. Documents with equal sets are one from the start, told by 128 bits of their set's hash.
    """
    own = identified(docs, shingles(F.col("text"), gram).alias("s"))
    # columns used twice stay computed once
    tokens = F.transform(prefix(F.col("s"), percent, SLACK), lambda t: F.shiftright(t, 24)).alias("tokens")
    own = own.select("doc_id", "h1", "h2", F.size("s").alias("n"), F.xxhash64("s").alias("s1"), F.xxhash64(F.lit("2"), "s").alias("s2"), tokens)
    rows = written(own.withColumn("uid", F.monotonically_increasing_id()), "ngram-rows")
    classes = rows.select("doc_id", "s1", "s2", "uid", "n").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("low"), F.min("uid").alias("uid"))
    classes = written(classes, "ngram-classes")
    copies = written(rows.select("uid").join(classes.select("uid"), "uid", "left_anti"), "ngram-copies")
    passed = written(sharing(rows.select("uid", "n", "tokens").join(copies, "uid", "left_anti"), needed(F.col("n"), percent, SLACK)), "ngram-passed")
    alive = written(rows.select("uid", "doc_id", "h1", "h2").join(passed, "uid", "left_semi"), "ngram-alive").withColumnRenamed("doc_id", "d")
    alive = alive.select("uid", "d", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    texts = perhaps_in(identified(docs, F.col("text")), F.col("h1"), alive, F.col("g1")).join(alive, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    sets = texts.select("uid", shingles(F.col("text"), gram).alias("tokens")).dropDuplicates(["uid"])
    labels = linked(written(sets.withColumn("n", F.size("tokens")), "ngram-sets"), percent)
    groups = classes.join(labels.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    lowest = groups.groupBy("label").agg(F.min("low").alias("component_id"))
    told = written(groups.join(lowest, "label").select("s1", "s2", "component_id"), "ngram-told")
    ids = rows.select("doc_id", "h1", "h2", "n", "s1", "s2").join(told, ["s1", "s2"])
    return ids.select("doc_id", "h1", "h2", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_each(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """docs with one row of every component: that of the smallest doc_id, of rows repeated with it one. Documents without words all stay.

    Columns as in docs, whatever their names.
    """
    found = clustered(docs, gram, percent)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("k_id"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.col("n_shingles") == 0).alias("empty")).distinct()
    keep = written(keep, "ngram-keep")
    rows = identified(docs, whole_row(docs)).join(keep, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    full = rows.where("not empty").dropDuplicates(["doc_id", "h1", "h2"])
    return full.select(*unpacked(docs)).unionByName(rows.where("empty").select(*unpacked(docs)))
