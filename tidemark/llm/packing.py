"""Mixture-controlled packing of documents into token sequences."""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: Tokens of a sequence; of a mixture window, in which sources get their shares; of a packet, which a source sends at once.
LENGTH, WINDOW, PACKET = 2048, 65_536, 1024
END_ID = 1
#: White space characters in a row from which the slower of two equal encoders takes a text.
LONG_RUN = 500
#: The split that byte-level vocabularies of this kind are made for (fixed value), and what equals it in texts without two blanks in a row.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such vocabularies: itself if printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def encoder(path: str, added: bool = False):
    """A function from a text to its ids, once for a worker.

    The ids are those of the library that the file is made for. Where the file's merges are numbered in order, as a
    table of ranks needs them, a faster library makes the same ids (tests hold them together), but for texts with long
    runs of white space, over which its search runs out of stack, and, with added, for texts that hold one of the
    file's added tokens literally, which the plain call recognises: these go to the file's own library.
    """
    model = json.load(open(path, encoding="utf-8"))
    vocabulary, merges = model["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    ordered = all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and not (model.get("pre_tokenizer") or {}).get("add_prefix_space")
    if ordered and (model.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not model.get("normalizer"):
        import tiktoken

        letters = byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items() if i < 256 + len(merges)}
        full, single = (tiktoken.Encoding(name, pat_str=split, mergeable_ranks=ranks, special_tokens={}) for name, split in (("full", SPLIT), ("single", SINGLE)))
        twice = re.compile(r"\s\s")
        fast = lambda text: (full if twice.search(text) else single).encode_ordinary(text)
        contents = [re.escape(t["content"]) for t in model.get("added_tokens") or []] if added else []
        holds, exact = re.compile("|".join([rf"\s{{{LONG_RUN}}}", *contents])).search, library(path, plain=not added)
        return lambda text: exact(text) if holds(text) else fast(text)
    return library(path, plain=not added)


def library(path: str, plain: bool = False):
    """The encoder of the library that the file is made for; plain: special tokens are text like other text."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = plain
    return lambda text: own.encode(text, add_special_tokens=False).ids


def tokenized(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, source (null: empty), n (ids with the end id), wide and ids (little-endian, 2 or 4 bytes each) of every document; null text: empty."""
    path = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path, added=True)
        for batch in batches:
            n, wide, packed = [], [], []
            for text in batch.column(2).to_pylist():
                ids = ids_of(text)
                ids.append(end_id)
                n.append(len(ids))
                wide.append(max(ids) > 65535)
                packed.append(np.array(ids, "<u4" if wide[-1] else "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(wide, pa.bool_()), pa.array(packed, pa.binary())], names=["doc_id", "source", "n", "wide", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, source string, n bigint, wide boolean, ids binary")


def running_total(rows: DataFrame, groups: list[str], order: list[str], value: str, name: str, column: str) -> DataFrame:
    """rows with column, the sum of value over the rows of its group up to and with it, in the given order, whose values must differ.

    Rows are dealt by range over groups and order, so that a hot group spreads over many tasks; what earlier
    ranges of a group hold is added from a table of one row per range and group.
    """
    dealt = written(rows.repartitionByRange(partitions(rows.sparkSession), *groups, *order).withColumn("_part", F.spark_partition_id()), name)
    sums = dealt.groupBy("_part", *groups).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    own = Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("_own", F.sum(value).over(own)).join(before, ["_part", *groups]).withColumn(column, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def scheduled(rows: DataFrame, window: int = WINDOW, packet: int = PACKET, weights: dict[str, float] | None = None) -> DataFrame:
    """uid, source, start, length, round and sent of each packet of rows (uid, doc_id, source, n).

    Deficit round-robin: every round a source with packets left gets its share of a window's tokens as credit and
    sends packets while its credit lasts; what is left is carried on. A source's packets have sizes a_1, a_2, ...,
    and after r rounds its credit so far is r * share * window, so packet i leaves in the first round r with
    r * share * window >= a_1 + ... + a_i: carried credits need no state, only a running total over each source,
    and are the same whatever the partitions. Shares are the sources' parts of all tokens, so that all run dry
    together, or weights (a source not named gets the least of them); then sources that run dry drop out.
    """
    packets = rows.withColumn("start", F.explode(F.expr(f"sequence(0L, n - 1, {packet}L)"))).withColumn("length", F.least(F.lit(packet), F.col("n") - F.col("start")))
    sent = running_total(packets.select("uid", "doc_id", "source", "start", "length"), ["source"], ["doc_id", "uid", "start"], "length", "packing-queues", "sent")
    totals = rows.groupBy("source").agg(F.sum("n").alias("_tokens"))
    if weights:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        totals = totals.withColumn("_tokens", F.coalesce(named[F.col("source")], F.lit(min(weights.values()))))
    every = totals.agg(F.sum("_tokens").alias("_all"))
    quanta = totals.join(F.broadcast(every)).select("source", (F.lit(float(window)) * F.col("_tokens") / F.col("_all")).alias("_quantum"))  # `every` is one row
    # one row a source: salted over each packet's queue position, so that a hot source's packets stay spread
    salts = 16
    quanta = quanta.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sent = sent.withColumn("_salt", F.pmod(F.xxhash64("uid", "start"), F.lit(salts)).cast("int"))
    return sent.join(quanta, ["source", "_salt"]).withColumn("round", F.ceil(F.col("sent") / F.col("_quantum"))).drop("_quantum", "_salt")


def laid_out(packets: DataFrame, length: int = LENGTH) -> DataFrame:
    """uid, start, length, sequence_id, offset and padded_to of the pieces, packets of a round in the order of their sources.

    Packets follow each other without a gap and are cut where a sequence is full; only the last sequence can be
    short, and is padded to the next power of two.
    """
    placed = running_total(packets.select("uid", "source", "start", "length", "round", "sent"), [], ["round", "source", "sent", "uid", "start"], "length", "packing-stream", "_end")
    all_tokens = packets.agg(F.sum("length").alias("_all"))
    first, last = F.col("_end") - F.col("length"), F.col("_end") - 1
    placed = placed.join(F.broadcast(all_tokens)).withColumn("sequence_id", F.explode(F.sequence(F.floor(first / length), F.floor(last / length))))  # one row
    low, high = F.greatest(first, F.col("sequence_id") * length), F.least(F.col("_end"), (F.col("sequence_id") + 1) * length)
    left = F.col("_all") - F.col("sequence_id") * length
    padded = F.when(left >= length, F.lit(length)).otherwise(F.least(F.lit(length), F.expr("cast(1 as bigint)") * F.pow(F.lit(2), F.length(F.bin(F.greatest(left - 1, F.lit(0)))) - F.when(left <= 1, 1).otherwise(0)).cast("long")))
    return placed.select("uid", (F.col("start") + low - first).alias("start"), (high - low).alias("length"), "sequence_id", (low - F.col("sequence_id") * length).alias("offset"), padded.cast("long").alias("padded_to"))


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, padded_to bigint"


def packed(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, window: int = WINDOW, packet: int = PACKET, weights: dict[str, float] | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Contract columns for every piece, padded_to and, if asked for, ids (array).

    Null and empty texts are one id, the end id. Null sources are one source of their own, named as the empty
    string; null doc_ids and repeated rows are documents like others. Other columns don't matter. No documents,
    no pieces.
    """
    tokens = written(tokenized(docs, vocabulary, end_id).withColumn("uid", F.monotonically_increasing_id()), "packing-ids")
    packets = written(scheduled(tokens.select("uid", "doc_id", "source", "n"), window, packet, weights), "packing-schedule")
    pieces = laid_out(packets, length).groupBy("uid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset", "padded_to")).alias("pieces"))
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8 + with_ids)]
            for doc_id, n, wide, data, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(data, "<u4" if wide else "<u2").astype("<u4")
                merged: list[list] = []
                for p in sorted(own, key=lambda p: p["start"]):
                    if merged and merged[-1][2] == p["sequence_id"] and merged[-1][1] + merged[-1][3] == p["offset"]:
                        merged[-1][1] += p["length"]
                    else:
                        merged.append([p["start"], p["length"], p["sequence_id"], p["offset"], p["padded_to"]])
                for start, size, sequence, offset, padded in merged:
                    part = ids[start : start + size]
                    row = [doc_id, start, size, zlib.crc32(part.tobytes()), n, sequence, offset, padded]
                    for column, value in zip(out, [*row, part.astype("<i4")] if with_ids else row, strict=True):
                        column.append(value)
            types = [pa.int64()] * 8 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    joined = tokens.join(pieces, "uid").select("doc_id", "n", "wide", "ids", "pieces")
    return joined.mapInArrow(digest, schema)
