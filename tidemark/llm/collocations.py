"""Phrase collocations from count streams in prefix and suffix order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: Words of a phrase at most, occurrences of a candidate at least, rows reported of a language.
WORDS, LEAST, TOP = 4, 30, 2000
#: A candidate is dropped if a longer one around it has this part of its occurrences, in percent.
COVERED = 80
SCALE = 2_000_000
#: Ends of pieces become commas, which no word can hold; blanks stay, A-Z become lower case.
LETTERS = bytes(44 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of text that a task looks at at once, if no single text is longer.
BLOCK = 2 << 20
#: Bits of the filter of frequent shorter phrases (4 MB, whatever goes into it), in Spark's bitmap blocks of 4096 bytes.
BITS, BLOCK_BITS = 1 << 25, 1 << 15
MULTIPLIER, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def places(hashes: np.ndarray) -> np.ndarray:
    """The filter's bit for each phrase hash."""
    mixed = (hashes ^ (hashes >> np.uint64(32))) * MIXER
    return (mixed >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)


def phrase_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row from those of the words; used for the filter only, never to tell phrases apart."""
    found = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        found = found * MULTIPLIER + words[j : len(words) - k + 1 + j]
    return found


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, seed=xxhash.xxh32_intdigest(lang.encode()))


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of each language, joined by commas into blocks."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for lang, text in ((x.as_py(), y.as_py()) for x, y in zip(batch.column(0), batch.column(1), strict=True)):
        held.setdefault(lang, []).append(text)
        sizes[lang] = sizes.get(lang, 0) + len(text)
        if sizes[lang] > BLOCK:
            yield lang, b",".join(held.pop(lang))
            sizes[lang] = 0
    for lang, texts in held.items():
        yield lang, b",".join(texts)


def counted(lang: str, text: bytes, k: int, bits: np.ndarray | None) -> tuple[pa.Array, np.ndarray] | None:
    """The distinct phrases of k words within pieces of a text, joined by blanks, and their counts.

    With bits only phrases both of whose phrases of k - 1 words may be frequent: a phrase with a rare part is rare itself.
    """
    words = pc.ascii_split_whitespace(pa.array([text.translate(LETTERS).replace(b",", b" , ")], pa.large_binary()).cast(pa.large_string())).flatten()
    words = words.filter(pc.not_equal(words, "")).dictionary_encode()
    ids, names = words.indices.to_numpy().astype(np.int64), words.dictionary
    if len(ids) < k:
        return None
    ends = pc.index(names, ",").as_py()
    at = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(ids != ends, k).all(axis=1))
    if bits is not None:
        own = np.array([word_hash(lang, w.encode()) for w in names.to_pylist()], np.uint64)
        bit = places(phrase_hashes(own[ids], k - 1))
        there = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
        at = at[(there[at] & there[at + 1]) == 1]
    if not len(at):
        return None
    key = ids[at]
    for j in range(1, k):  # pairs of (phrase so far, next word) are numbered anew, so that they fit 64 bits
        if j > 1:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key << 32 | ids[at + j]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    parts = [names.take(pa.array(ids[at[first] + j])) for j in range(k)]
    return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())), n


def phrase_counts(rows: DataFrame, k: int, bits: Broadcast | None) -> DataFrame:
    """lang, phrase and f of the phrases of k words in rows (lang, text); see counted()."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(bits.value, np.uint8) if bits else None
        for batch in batches:
            for lang, text in blocks(batch):
                found = counted(lang, text, k, own)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found[1])), found[0].cast(pa.string()), pa.array(found[1])], names=["lang", "phrase", "n"])

    return rows.mapInArrow(count, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def filter_of(phrases: DataFrame, k: int) -> Broadcast:
    """The bits of all phrases of k words (lang, phrase), for every task. Its size is BITS, however many there are."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for batch in batches:
            own = [[word_hash(lang, w.encode()) for w in phrase.split(" ")] for lang, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if own:
                words = np.array(own, np.uint64)
                found = words[:, 0].copy()
                for j in range(1, k):
                    found = found * MULTIPLIER + words[:, j]
                bits[places(found)] = True
        packed = np.packbits(bits, bitorder="little").reshape(-1, BLOCK_BITS // 8)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([packed[i].tobytes() for i in some], pa.binary())], names=["block", "bits"])

    parts = phrases.select("lang", "phrase").mapInArrow(marked, "block bigint, bits binary").groupBy("block").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
    whole = bytearray(BITS // 8)
    for row in parts.collect():  # BITS / BLOCK_BITS rows at most
        whole[row["block"] * BLOCK_BITS // 8 : (row["block"] + 1) * BLOCK_BITS // 8] = row["bits"]
    return phrases.sparkSession.sparkContext.broadcast(bytes(whole))


SCANNED = "lang string, key array<string>, f bigint, shorter array<bigint>, longer bigint, part int, open boolean"


def scanned(stream: DataFrame) -> DataFrame:
    """SCANNED for a stream (lang, key, f), dealt by range and sorted by lang and key.

    A phrase comes right after all phrases that it begins with, so a stack of them has their counts (shorter, by
    length) and meets the counts of its own extensions by a word (longer, the largest): one pass in step, and nothing
    is looked up. Rows of a part's first phrases that stand in earlier parts are listed as open, without f.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # lang, key, f, shorter, longer, part, open
        out: list[list] = []
        begun = False

        def close() -> None:
            out.append(stack.pop())

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.bool_()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SCANNED.split(", ")])

        for batch in batches:
            for lang, key, f, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun:
                    begun = True
                    stack += [[lang, key[:n], None, [None] * (n - 1), None, part, True] for n in range(1, len(key))]
                while stack and (stack[-1][0] != lang or stack[-1][1] != key[: len(stack[-1][1])]):
                    close()
                if stack:
                    stack[-1][4] = max(f, stack[-1][4] or 0)
                stack.append([lang, key, f, [x[2] for x in stack], None, part, False])
            yield batch_of()
        while stack:
            close()
        yield batch_of()

    return stream.select("lang", "key", "f", F.spark_partition_id().alias("part")).mapInArrow(scan, SCANNED)


def annotated(phrases: DataFrame, key: Column, name: str) -> DataFrame:
    """lang, key, f, shorter and longer of all phrases (lang, words, f), in the order of key.

    What a part of the stream lacks stands in the few open rows at its beginning: at most WORDS - 1 a part, so they
    are joined by broadcast.
    """
    stream = phrases.select("lang", key.alias("key"), "f").repartitionByRange(partitions(phrases.sparkSession), "lang", "key").sortWithinPartitions("lang", "key")
    rows = written(scanned(stream), name)
    whole, open_ = rows.where(~F.col("open")).drop("open"), rows.where("open")
    met = open_.groupBy("lang", "key").agg(F.max("longer").alias("more"))
    known = whole.join(F.broadcast(met.select("lang", "key")), ["lang", "key"]).select("lang", "key", "f")
    given = open_.select("lang", "key", "part").join(F.broadcast(known), ["lang", "key"]).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.size("key"), "f"))).alias("given"))
    whole = whole.join(F.broadcast(met), ["lang", "key"], "left").join(F.broadcast(given), "part", "left")
    shorter = F.transform("shorter", lambda f, i: F.coalesce(f, F.col("given")[i + 1]))
    return whole.select("lang", "key", "f", shorter.alias("shorter"), F.greatest("longer", "more").alias("longer"))


def mined(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's collocations of two to four words.

    Phrases of one word more are counted over all texts among those whose parts are frequent, so nothing frequent is
    missed and nothing rare is dealt out but for the filter's few errors. The counts are streams in prefix order, where
    a phrase's left parts and right extensions lie on the way, and in suffix order, where its right parts and left
    extensions do; both annotated streams are sorted by phrase and merged. Null texts are empty, null langs und; every
    row counts, repeated ones too; no frequent phrase, no row; other columns, whatever their names, don't matter.
    """
    rows = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))
    words = written(phrase_counts(rows, 1, None), "collocations-1")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = [words.where(F.col("f") >= least)]
    for k in range(2, WORDS + 1):
        bits = filter_of(frequent[-1], k - 1)
        frequent.append(written(phrase_counts(rows, k, bits).where(F.col("f") >= least), f"collocations-{k}"))
    every = frequent[0]
    for more in frequent[1:]:
        every = every.unionByName(more)
    every = every.select("lang", F.split("phrase", " ").alias("words"), "f")
    prefix = annotated(every, F.col("words"), "collocations-prefix")
    suffix = annotated(every, F.reverse("words"), "collocations-suffix")
    left = prefix.where(F.size("key") > 1).select("lang", "key", F.col("f").alias("a"), F.col("shorter").alias("lefts"), F.col("longer").alias("to_right"))
    right = suffix.where(F.size("key") > 1).select("lang", F.reverse("key").alias("key"), F.col("shorter").alias("rights"), F.col("longer").alias("to_left"))
    both = left.hint("merge").join(right, ["lang", "key"])
    around = F.coalesce(F.greatest("to_left", "to_right"), F.lit(0))
    wide = lambda c: c.cast("decimal(18,0)")
    score = lambda l, r: F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(F.col("a")), wide(l + r))
    cut = lambda l, i: F.struct(score(l, F.get("rights", F.size("rights") - 1 - i)).alias("score"), i.alias("k"), l.alias("l"), F.get("rights", F.size("rights") - 1 - i).alias("r"))
    best = both.where(100 * around < covered * F.col("a")).withColumn("cut", F.array_min(F.transform("lefts", cut)))
    best = best.select("lang", F.array_join("key", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    # the best of each part of a language first: no task has more than its part
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    best = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = best.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("nth") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
