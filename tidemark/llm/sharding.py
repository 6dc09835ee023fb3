"""Shards from a Feistel permutation of global row numbers."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

PRIME = 2_147_483_647
FACTOR = 1_103_515_245
#: One key a half round; together with the row count they fix the permutation.
KEYS = (748_021, 1_299_709, 32_452_843, 67_867_967, 179_424_673, 322_604_089, 533_000_389, 982_451_653)


def sides(n: int) -> tuple[int, int]:
    """The two halves' moduli: a * b >= n and a * b - n < a, so that few values lie outside of 0 .. n - 1."""
    a = max(1, isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permute(x: str, n: int, keys: tuple[int, ...] = KEYS) -> str:
    """SQL for the image of x, a number below n, under the permutation of 0 .. n - 1.

    Each half round adds a mixed half to the other, modulo that half's size: a bijection of a x b grid cells.
    Cells past n - 1 are walked on from until the walk comes back below n. At most a - 1 cells lie outside and
    one is hit with a chance of 1 / sqrt(n) a step, so that 64 steps end every walk; were one to go on, the
    row would raise an error and never get a wrong place.
    """
    a, b = sides(n)
    rounds = ", ".join(f"named_struct('k', {k}L, 's', {i % 2})" for i, k in enumerate(keys))
    mixed = lambda v: f"pmod(pmod({v} * {FACTOR}L + k.k, {PRIME}L) * pmod({v} * {FACTOR}L + k.k, {PRIME}L) + k.k, {PRIME}L)"
    once = lambda v: (
        f"aggregate(array({rounds}), named_struct('l', pmod({v}, {a}L), 'r', {v} div {a}L), (c, k) -> named_struct("
        f"'l', if(k.s = 0, pmod(c.l + {mixed('c.r')}, {a}L), c.l), 'r', if(k.s = 1, pmod(c.r + {mixed('c.l')}, {b}L), c.r)), c -> c.r * {a}L + c.l)"
    )
    walked = f"aggregate(sequence(1, 64), {once(f'cast({x} as bigint)')}, (y, i) -> if(y < {n}L, y, {once('y')}))"
    return f"transform(array({walked}), y -> if(y < {n}L, y, cast(raise_error('the walk did not end') as bigint)))[0]"


def shuffled(df: DataFrame, order: list[str], shards: int, keys: tuple[int, ...] = KEYS) -> DataFrame:
    """df with row_number, place (the permuted number), shard and slot.

    Row numbers follow the given order; shard = place % shards and slot = place div shards, so that a row's
    place can be computed from its number alone, shard sizes differ by one at most and slots have no gaps.
    The same rows in the same order are dealt alike on every run. An empty table stays empty; with more
    shards than rows some shards are empty; rows equal in all order columns share their places in any order.
    """
    if shards < 1:
        raise ValueError("shards must be 1 at least")
    rows = numbered(df, order, "sharding")
    n = rows.count()
    place = F.expr(permute("row_number", n)) if n else F.lit(0).cast("long")
    return rows.withColumn("place", place).withColumn("shard", F.expr(f"cast(place % {shards} as int)")).withColumn("slot", F.expr(f"place div {shards}"))


def document_rows(docs: DataFrame, columns: tuple[Column, ...] = ()) -> DataFrame:
    """Per document doc_id, size (UTF-8 bytes of the text plus 16; null: 16) and text_crc32 (null: that of no bytes, 0)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *columns)


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Contract columns for documents, law `rows`: shard row counts are at most one apart.

    Documents are numbered by doc_id (null first), then size and checksum. Rows with nulls, empty or very
    long texts and repeated rows are rows like others, each with a slot of its own; other columns don't matter.
    """
    placed = shuffled(document_rows(docs), ["doc_id", "size", "text_crc32"], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
