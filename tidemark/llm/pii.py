"""Personal data: fixed patterns, and identifiers that contexts learnt from them give away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, kept_where, let, marked, perhaps_in, sums_before, unpacked, whole_row, written

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
#: The contract's patterns, written for a backtracking engine: runs are taken whole (possessive), and a match starts
#: where a run starts or the last match ended, so that no text takes more than linear time. Same matches.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # of maximal runs of digits with single separators only those of 13 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP_VALID = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: Key-like runs: 16 characters at least, with a letter and a digit. They vote for the patterns they stand in, as seeds
#: do, but are taken for identifiers only where patterns say so.
KEY_LIKE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+"
#: A text's pieces: runs of letters and digits, other characters, line ends. With the blanks before each they tile it.
PIECE = r"(?:[\p{L}\p{N}_]++|\n|[^\s\p{L}\p{N}_])"
TILE = r"[^\S\n]*+" + PIECE
#: An identifier has so many code points at most and stands on one line.
LONGEST = 256
#: A pattern counts if so many distinct instances that are held true have it and their share of its instances is this.
MIN_SUPPORT, MIN_PRECISION = 5, 0.6
#: And if its distinct instances that are held true are so many as this share of its places in their own documents:
#: common words stand before some of them by chance. Nothing here hangs on how large the corpus is.
MIN_PLACES = 0.02
#: Places are counted in one of so many texts first, then in more of them, last in all.
PARTS = (64, 8, 1)
#: Occurrences in one text up to which its pieces are picked where they lie; beyond, all pieces are dealt out.
FEW = 64
#: What follows is part of a pattern if it follows so many of the values that are held true behind the same words.
USUAL = 0.9
#: An instance is held true from this confidence on.
MIN_CONFIDENCE = 0.6
_SPANS = "array<struct<value:string,start:int,end:int>>"


def spans(text: Column, pattern: Column | str) -> Column:
    """(value, start, end) of all matches of a pattern without empty ones, in code points, end exclusive."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(m: Column, parts: Column) -> Column:
        steps = F.transform(m, lambda x, i: F.length(parts[i]) + F.length(x))
        return let(sums_before(steps), lambda at: F.transform(m, lambda x, i: F.struct(x.alias("value"), (at[i] + F.length(parts[i])).cast("int").alias("start"), (at[i] + F.length(parts[i]) + F.length(x)).cast("int").alias("end"))))

    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    return let(matches, lambda m: F.when(F.size(m) == 0, F.array().cast(_SPANS)).otherwise(let(F.split(text, pattern, -1), lambda p: placed(m, p))))


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + let(F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: d - F.when(d > 9, 9).otherwise(0)))
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """(kind, value, start, end) of the fixed patterns' matches that hold, by kind as listed, then start."""
    holds = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: v.rlike(IP_VALID),
        "card": lambda v: luhn(F.regexp_replace(v, "[^0-9]", "")),
        "phone": lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15),
    }
    sign = {"email": "@", "phone": "+"}
    empty = F.array().cast("array<struct<kind:string,value:string,start:int,end:int>>")

    def one(kind: str) -> Column:
        found = F.filter(spans(text, PATTERNS[kind]), lambda x: holds[kind](x["value"]))
        found = F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["value"].alias("value"), x["start"].alias("start"), x["end"].alias("end")))
        there = F.instr(text, sign[kind]) > 0 if kind in sign else text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else "[0-9]")
        return F.when(there, found).otherwise(empty)

    return F.concat(*[one(kind) for kind in KINDS])


def own_rows(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns given, doc_id, h1, h2 (the text's hash: what is found hangs on nothing else) and text (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*columns, "doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("2"), text).alias("h2"), text.alias("text"))


def plain(text: Column) -> Column:
    """A-Z in lower case and digits as 0, each character in its place."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")


def pieces(text: Column, pattern: str = PIECE) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def key_before(p: Column, i: Column) -> Column:
    """The hash of the two pieces before the i-th one, a line's end before the first: the shorter of two lefts."""
    return F.xxhash64(F.coalesce(F.get(p, i - 2), F.lit("\n")), F.get(p, i - 1))


def longer_before(p: Column, i: Column) -> Column:
    """The hash of the three pieces before the i-th one."""
    return F.xxhash64(F.lit(3), F.coalesce(F.get(p, i - 3), F.lit("\n")), F.coalesce(F.get(p, i - 2), F.lit("\n")), F.get(p, i - 1))


def seeds(rows: DataFrame) -> DataFrame:
    """h1, h2, value, start and end of the fixed patterns' matches and of key-like runs outside of them; sure: of the former."""
    base = F.transform(base_spans(F.col("text")), lambda b: F.struct(b["value"].alias("value"), b["start"].alias("start"), b["end"].alias("end"), F.lit(True).alias("sure")))
    keys = F.when(F.col("text").rlike("[0-9]"), F.transform(spans(F.col("text"), KEY_LIKE), lambda s: F.struct(s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end"), F.lit(False).alias("sure"))))
    found = rows.select("h1", "h2", base.alias("b"), F.coalesce(keys, F.array().cast("array<struct<value:string,start:int,end:int,sure:boolean>>")).alias("k"))
    outside = F.filter("k", lambda s: ~F.exists("b", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.select("h1", "h2", F.explode(F.concat("b", F.when(F.size("k") > 0, outside).otherwise(F.col("k")))).alias("x")).select("h1", "h2", "x.*").distinct()


def texts_of(rows: DataFrame, there: DataFrame) -> DataFrame:
    """rows (h1, h2, text) joined with there (h1, h2 and more, one row a text), one row a text."""
    there = there.withColumnRenamed("h1", "t1").withColumnRenamed("h2", "t2")
    near = perhaps_in(rows.select("h1", "h2", "text"), F.col("h1"), there, F.col("t1"))
    return near.join(there, (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2"))).drop("t1", "t2").dropDuplicates(["h1", "h2"])


def patterns_of(rows: DataFrame, occurrences: DataFrame) -> DataFrame:
    """value, key, left and right of the patterns around occurrences (h1, h2, value, start, end).

    left is the hash of the two or the three pieces before, key that of two; right is the next piece, with a blank if
    one stands between, $ at a line's end; every left makes a pattern without right as well, whose instances end at
    the next blank. Pieces and occurrences are joined by their places, so that no text is searched once an occurrence.
    """
    there = occurrences.groupBy("h1", "h2").agg(F.collect_set("start").alias("starts"), F.collect_set("end").alias("stops"))
    own = texts_of(rows, there).select("h1", "h2", "starts", "stops", pieces(plain(F.col("text")), TILE).alias("t"))
    own = own.select("h1", "h2", "starts", "stops", "t", F.transform("t", lambda x: F.ltrim(x)).alias("p"), sums_before(F.transform("t", lambda x: F.length(x))).alias("ends"))
    at = lambda i: (F.get("ends", i) + F.length(F.get("t", i)) - F.length(F.get("p", i))).cast("int")
    met = lambda i: (F.size("starts") > FEW) | F.array_contains("starts", at(i)) | F.array_contains("stops", F.get("ends", i).cast("int"))
    told = lambda i: F.struct(F.get("ends", i).cast("int").alias("from"), at(i).alias("at"), F.when(i > 0, key_before(F.col("p"), i)).alias("key"), F.when(i > 0, longer_before(F.col("p"), i)).alias("longer"), F.when(F.get("p", i) == "\n", "$").when(F.length(F.get("t", i)) > F.length(F.get("p", i)), F.concat(F.lit(" "), F.get("p", i))).otherwise(F.get("p", i)).alias("right"))
    some = F.filter(F.sequence(F.lit(0), F.size("p") - 1), met)
    tiles = written(own.where(F.size("p") > 0).select("h1", "h2", F.explode(F.transform(some, told)).alias("x")).select("h1", "h2", "x.*"), "pii-tiles")
    before = occurrences.join(tiles.where("key is not null").select("h1", "h2", F.col("at").alias("start"), "key", "longer"), ["h1", "h2", "start"])
    both = before.join(tiles.select("h1", "h2", F.col("from").alias("end"), "right"), ["h1", "h2", "end"], "left")
    each = both.select("value", "key", "right", F.explode(F.array("key", "longer")).alias("left"))
    return each.where("right is not null").unionByName(each.withColumn("right", F.lit(""))).distinct()


def slots(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """h1, h2, key, left, right, value, start and end of all that stands in the slots of patterns (key, left, right) in rows.

    A slot holds what follows left on its line: up to the next blank, or up to right; signs at its ends don't count.
    A bitmap of the keys picks a text's places where it is read, so that no text is dealt; the join with patterns is exact.
    """
    own = rows.select("h1", "h2", "text", pieces(plain(F.col("text")), TILE).alias("t")).select("h1", "h2", "text", "t", F.transform("t", lambda x: F.ltrim(x)).alias("p"))
    own = own.join(F.broadcast(bitmap(patterns, F.col("key")))).join(F.broadcast(bitmap(patterns, F.col("left")).withColumnRenamed("b_words", "b_lefts")))  # one row each
    at = F.when(F.size("p") > 1, F.filter(F.sequence(F.lit(1), F.size("p") - 1), lambda i: marked(F.col("b_words"), key_before(F.col("p"), i))))
    found = kept_where(own.select("h1", "h2", "text", "t", "p", "b_lefts", at.alias("at")), F.size("at") > 0)
    found = found.select("h1", "h2", "text", "at", "p", "b_lefts", sums_before(F.transform("t", lambda x: F.length(x))).alias("ends"))
    # the line's rest is cut before rows are made, so that no row holds a whole text
    tail = lambda at: F.substring_index(F.col("text").substr(at + 1, F.lit(LONGEST + 64)), "\n", 1)
    told = lambda i: let(F.get("ends", i).cast("int"), lambda at: F.struct(at.alias("from"), tail(at).alias("tail"), F.filter(F.array(key_before(F.col("p"), i), longer_before(F.col("p"), i)), lambda x: marked(F.col("b_lefts"), x)).alias("lefts")))
    found = found.select("h1", "h2", F.explode(F.transform("at", told)).alias("x")).select("h1", "h2", "x.from", "x.tail", F.explode("x.lefts").alias("left"))
    found = found.join(patterns, "left")
    signs = F.regexp_extract("tail", r"^\s*[^\p{L}\p{N}\s+]*", 0)
    found = found.withColumn("start", F.col("from") + F.length(signs)).withColumn("tail", F.expr("substring(tail, start - from + 1, length(tail))"))
    upto = let(F.position(F.col("right"), plain(F.col("tail"))), lambda n: F.when(n > 1, F.col("tail").substr(F.lit(1), n - 1)).otherwise(""))
    upto = F.when(F.col("right") == "$", F.col("tail")).otherwise(upto)
    run = F.when(F.col("right") == "", F.regexp_extract("tail", r"^\S+", 0)).otherwise(upto)
    value = F.regexp_replace(run, r"[^\p{L}\p{N}]+$", "")
    found = found.withColumn("value", value).where(F.length("value").between(1, LONGEST))
    return found.select("h1", "h2", "key", "left", "right", "value", "start", (F.col("start") + F.length("value")).alias("end")).distinct()


def placed(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """left and n_places: how often the lefts of patterns stand in rows (h1, h2, text), summed up by task before they are dealt."""
    lefts = patterns.select("left").distinct()
    own = rows.select(pieces(plain(F.col("text"))).alias("p")).join(F.broadcast(bitmap(lefts, F.col("left"))))  # one row
    both = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.filter(F.array(key_before(F.col("p"), i), longer_before(F.col("p"), i)), lambda x: marked(F.col("b_words"), x)))
    each = own.where(F.size("p") > 1).select(F.explode(F.flatten(both)).alias("left"))
    counts = perhaps_in(each, F.col("left"), lefts.withColumnRenamed("left", "l"), F.col("l")).groupBy("left").agg(F.count(F.lit(1)).alias("n_places"))
    return counts.join(lefts, "left", "left_semi")


def seldom_by_chance(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Those of patterns (key, left, right, of) whose instances are MIN_PLACES of all places of their lefts in rows (h1, h2, text), at least.

    The more seeds there are, the more common words stand before five of them by chance, and these stand everywhere. What a
    part of the texts holds is a lower bound, so such lefts go by a few of their places: of one that stays until the next
    part at most 8 * of / MIN_PLACES places are to be expected there. Those left are counted in all texts.
    """
    for n in PARTS:
        counts = placed(rows.where(F.pmod("h1", F.lit(n)) == 0) if n > 1 else rows, patterns)
        met = patterns.join(counts, "left", "left_outer" if n > 1 else "inner")
        few = F.col("of") >= MIN_PLACES * F.coalesce("n_places", F.lit(0))
        patterns = written(met.where(few).select(*patterns.columns), "pii-wanted")
    return patterns


def scored(edges: DataFrame, sure: DataFrame, min_support: int, min_precision: float, min_confidence: float) -> DataFrame:
    """left, right and value of the edges (key, left, right, value) between accepted patterns and values that are held true.

    A round scores each pattern by the share of its distinct instances that are held true, then each instance by
    1 - the product of (1 - precision) over its patterns that count, of those with the same two pieces before it over
    the best, as they say the same; those that are sure stay held. Rounds follow
    until no value is added. Sums are partial: a frequent pattern or value costs no more than its distinct partners.
    """
    held, size = sure, -1
    while True:
        marked = edges.join(held.withColumn("true", F.lit(1)), "value", "left")
        good = marked.groupBy("left", "right").agg(F.count("true").alias("support"), (F.count("true") / F.count(F.lit(1))).alias("precision"))
        good = good.where((F.col("support") >= min_support) & (F.col("precision") >= min_precision))
        graph = written(edges.join(good, ["left", "right"]), "pii-graph")
        belief = graph.groupBy("value", "key").agg(F.max("precision").alias("precision")).groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("precision"), F.lit(1e-9)))))).alias("confidence"))
        new = belief.where(F.col("confidence") >= min_confidence).select("value")
        held = written(sure.unionByName(new).distinct(), "pii-held")
        n = held.count()
        if n == size:
            return graph.join(new, "value").select("left", "right", "value")
        size = n


def elsewhere(rows: DataFrame, values: DataFrame) -> DataFrame:
    """h1, h2, value, start and end of every place where one of values stands between blanks or signs.

    Texts and values meet by the hash of a value's first two words (of one word, if it has no more). A bitmap of these
    picks a text's places where it is read, in one pass whatever the number of values, and what lies there is compared.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    pair = lambda w, i: F.xxhash64(F.lit(2), F.get(w, i), F.get(w, i + 1))
    single = lambda w, i: F.xxhash64(F.lit(1), F.get(w, i))
    v = values.select("value", words(F.col("value")).alias("w")).where(F.size("w") > 0)
    v = v.select("value", F.when(F.size("w") > 1, pair(F.col("w"), F.lit(0))).otherwise(single(F.col("w"), F.lit(0))).alias("key"), F.length(F.regexp_extract("value", r"^[^\p{L}\p{N}]*", 0)).alias("lead"))
    v = written(v, "pii-values")
    own = rows.select("h1", "h2", "text", words(F.col("text")).alias("w")).join(F.broadcast(bitmap(v, F.col("key"))))  # one row
    keys = lambda i: F.filter(F.array(single(F.col("w"), i), pair(F.col("w"), i)), lambda k: marked(F.col("b_words"), k))
    at = lambda i: F.get("s", i)["start"]
    # the text around a place, from as many signs before it as a value can begin with
    told = lambda i: F.struct(at(i).alias("at"), F.least(at(i), F.lit(LONGEST)).alias("back"), F.col("text").substr(F.greatest(at(i) - LONGEST, F.lit(0)) + 1, F.least(at(i), F.lit(LONGEST)) + LONGEST + 1).alias("near"), keys(i).alias("keys"))
    some = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: marked(F.col("b_words"), single(F.col("w"), i)) | marked(F.col("b_words"), pair(F.col("w"), i)))
    found = kept_where(own.select("h1", "h2", "text", "w", "b_words", F.when(F.size("w") > 0, some).alias("some")), F.size("some") > 0)
    found = kept_where(found.select("h1", "h2", "text", "w", "b_words", "some", spans(F.col("text"), r"[\p{L}\p{N}]+").alias("s")), F.size("s") > 0)
    hits = found.select("h1", "h2", F.explode(F.transform("some", told)).alias("x")).select("h1", "h2", "x.at", "x.back", "x.near", F.explode("x.keys").alias("key"))
    met = hits.join(v, "key").withColumn("start", F.col("at") - F.col("lead")).where(F.col("start") >= F.col("at") - F.col("back"))
    first, n = F.col("back") - F.col("lead") + 1, F.length("value")
    alone = ~F.col("near").substr(first - 1, F.when(first > 1, 1).otherwise(0)).rlike(r"[\p{L}\p{N}]") & ~F.col("near").substr(first + n, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    met = met.where((F.col("near").substr(first, n) == F.col("value")) & alone)
    return met.select("h1", "h2", "value", "start", (F.col("start") + n).alias("end")).distinct()


def discovered(rows: DataFrame, min_support: int = MIN_SUPPORT, min_precision: float = MIN_PRECISION, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """h1, h2, start and end of identifiers that no fixed pattern finds, for rows (h1, h2, text).

    Seeds induce patterns: what several of them stand behind. Those that hold little else even in the seeds' own
    documents are looked for in all documents, and patterns and instances are scored over all of them. Values held
    true for the first time are looked for everywhere; where they stand, they induce further patterns, until none comes.
    """
    found = written(seeds(rows), "pii-seeds")
    voters = written(found.select("value").distinct(), "pii-voters")
    new, tried, edges, places = found.select("h1", "h2", "value", "start", "end"), None, None, None
    sides = None
    pattern = ["key", "left", "right"]
    while True:
        around = patterns_of(rows, new)
        sides = written(around if sides is None else sides.unionByName(around).distinct(), "pii-sides")
        wanted = sides.groupBy(*pattern).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_support)
        usual = wanted.where("right = ''").select("left", F.col("c").alias("of"))
        wanted = wanted.join(usual, "left").where((F.col("right") == "") | (F.col("c") >= USUAL * F.col("of"))).select(*pattern, "of")
        wanted = written(wanted if tried is None else wanted.join(tried, pattern, "left_anti"), "pii-wanted")
        tried = wanted.select(*pattern) if tried is None else written(tried.unionByName(wanted.select(*pattern)), "pii-tried")
        if wanted.isEmpty():
            break
        there = written(new.select("h1", "h2").distinct(), "pii-own")
        texts = perhaps_in(rows.select("h1", "h2", "text"), F.col("h1"), there, F.col("h1"))
        wanted = seldom_by_chance(texts, wanted).select(*pattern)
        own = slots(texts, wanted).join(there, ["h1", "h2"], "left_semi")
        near = own.select("left", "right", "value").distinct().join(voters.withColumn("true", F.lit(1)), "value", "left")
        likely = near.groupBy("left", "right").agg((F.count("true") / F.count(F.lit(1))).alias("p")).where(F.col("p") >= min_precision).select("left", "right")
        wanted = written(wanted.join(likely, ["left", "right"], "left_semi"), "pii-wanted")
        if wanted.isEmpty():
            break
        here = slots(rows, wanted)
        places = written(here if places is None else places.unionByName(here), "pii-places")
        edges = written(places.select("key", "left", "right", "value").distinct(), "pii-edges")
        graph = scored(edges, voters, min_support, min_precision, min_confidence)
        added = written(graph.select("value").distinct().join(voters, "value", "left_anti"), "pii-added")
        if added.isEmpty():
            break
        voters = written(voters.unionByName(added), "pii-voters")
        new = written(elsewhere(rows, added), "pii-elsewhere")
    if places is None:
        return found.select("h1", "h2", "start", "end").limit(0)
    graph = scored(edges, voters, min_support, min_precision, min_confidence)
    sure = found.where("sure").groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "end")).alias("base"))
    told = places.join(graph, ["left", "right", "value"]).groupBy("h1", "h2", "start").agg(F.max("end").alias("end"))  # the longest that starts there
    told = told.join(sure, ["h1", "h2"], "left")
    free = F.col("base").isNull() | ~F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    return written(merged(told.where(free).select("h1", "h2", "start", "end", F.lit(FOUND).alias("kind"))).select("h1", "h2", "start", "end"), "pii-found")


def merged(found: DataFrame) -> DataFrame:
    """found (h1, h2, start, end, kind) with overlapping spans of a text as one, of the first one's kind."""
    order = Window.partitionBy("h1", "h2").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    heads = found.withColumn("head", F.when(reach.isNull() | (reach <= F.col("start")), 1).otherwise(0))
    groups = heads.withColumn("number", F.sum("head").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return groups.groupBy("h1", "h2", "number").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind")).drop("number")


def extracted(docs: DataFrame) -> DataFrame:
    """Contract columns for documents; identifiers found by context are spans of kind id, after the others, disjoint from them.

    Null text: empty, no spans. Rows with equal texts get equal spans. Other columns, whatever their names, don't
    matter. An empty table stays empty.
    """
    told = lambda x, kind: F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string"))
    new = discovered(own_rows(docs)).groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("found"))
    rows = own_rows(docs).select("doc_id", "h1", "h2", base_spans(F.col("text")).alias("base")).join(new, ["h1", "h2"], "left")
    base = F.transform("base", lambda x: told(x, x["kind"]))
    rows = rows.select("doc_id", "base", base.alias("_told"), F.transform(F.coalesce("found", F.array().cast("array<struct<start:int,end:int>>")), lambda x: told(x, F.lit(FOUND))).alias("_new"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return rows.select("doc_id", *counts, F.sha2(F.array_join("_told", ","), 256).alias("base_sha256"), F.array_join(F.concat("_told", "_new"), ",").alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets, overlapping ones together by the first's; n_chars, if there, counts the new text.

    Null texts stay null. Columns as in docs, whatever their names.
    """
    rows = own_rows(docs)
    base = rows.select("h1", "h2", F.explode(base_spans(F.col("text"))).alias("x")).select("h1", "h2", "x.start", "x.end", "x.kind").distinct()
    every = merged(base.unionByName(discovered(rows).withColumn("kind", F.lit(FOUND))))
    per = written(every.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("s")), "pii-spans")
    joined = own_rows(docs, whole_row(docs)).join(per, ["h1", "h2"], "left")
    kept = F.transform("s", lambda h, i: F.concat(F.col("text").substr(F.coalesce(F.get("s", i - 1)["end"], F.lit(0)) + 1, h["start"] - F.coalesce(F.get("s", i - 1)["end"], F.lit(0))), F.lit("<"), F.upper(h["kind"]), F.lit(">")))
    rest = F.expr("substring(text, element_at(s, -1).end + 1, length(text))")
    joined = joined.select("row", F.when(F.col("s").isNull(), F.col("row.text")).otherwise(F.concat(F.array_join(kept, ""), rest)).alias("left"))
    return joined.select(*unpacked(docs, text=F.col("left")))
