"""Repeated byte strings: enhanced suffix arrays over the contexts of repeated anchors."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written

LENGTH, GRAM = 200, 64
#: Contexts of one anchor that one task sorts; those of more frequent anchors are dealt window by window.
GROUP = 2000
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@functools.lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(b))]).astype(np.uint64)) for b in (BASE, INVERSE))
    return up, down


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def anchor_runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """at, first, last, gram_hash, span_hash of each run of windows (strings of `length` bytes) with one anchor.

    A window's anchor is the leftmost of its least-hashed `gram`-byte strings: equal windows have theirs at the
    same offset, wherever they are. span_hash covers everything from the first window's start to the last one's end.
    """
    n, w = len(data), length - gram + 1
    size = 1 << max(16, n.bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        key = _mixed((sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1])
    m = len(key)
    blocks = -(-m // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = key
    grid, place = padded.reshape(blocks, w), np.arange(blocks * w).reshape(blocks, w)
    head = np.minimum.accumulate(grid, axis=1)
    new = np.ones_like(grid, bool)
    new[:, 1:] = grid[:, 1:] < head[:, :-1]
    head_at = np.maximum.accumulate(np.where(new, place, 0), axis=1).ravel()
    back = grid[:, ::-1]
    tail = np.minimum.accumulate(back, axis=1)
    new = np.ones_like(grid, bool)
    new[:, 1:] = back[:, 1:] <= tail[:, :-1]
    tail_at = np.minimum.accumulate(np.where(new, place[:, ::-1], blocks * w), axis=1)[:, ::-1].ravel()
    head, tail = head.ravel(), tail[:, ::-1].ravel()
    count = n - length + 1
    at = np.where(tail[:count] <= head[w - 1 : w - 1 + count], tail_at[:count], head_at[w - 1 : w - 1 + count])
    cuts = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], cuts])
    last = np.concatenate([cuts, [count]]) - 1
    at = at[first]
    with np.errstate(over="ignore"):
        span = _mixed((sums[last + length] - sums[first]) * down[first] + np.uint64(0x51ED27))
    return at, first, last, key[at].view(np.int64), span.view(np.int64)


RUNS = "doc_id bigint, h1 bigint, at int, lo int, hi int, gram bigint, span bigint"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h1 (the text's hash) and data (UTF-8; null: empty): rows equal in the first two are copies and treated alike."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.encode(text, "UTF-8").alias("data"))


def all_runs(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The runs (columns RUNS) of keyed rows; lo and hi are the windows' least and greatest distance from start to anchor."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc_id, h1, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                data = data.as_py()
                if len(data) >= length:
                    at, first, last, key, span = anchor_runs(data, length, gram)
                    parts.append((pa.array([doc_id.as_py()] * len(at), pa.int64()), np.full(len(at), h1.as_py()), at.astype(np.int32), (at - last).astype(np.int32), (at - first).astype(np.int32), key, span))
            for low in range(0, len(parts), 500):
                some = parts[low : low + 500]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([p[0] for p in some]), *(pa.array(np.concatenate([p[i] for p in some])) for i in range(1, 7))], names=[x.split()[0] for x in RUNS.split(", ")])

    return rows.mapInArrow(runs, RUNS)


def common_length(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def intervals(suffixes: list[bytes], least: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The suffix array and, from a stack scan of its common prefixes, every interval (depth, low, high) of at least `least` bytes.

    An interval is a maximal set of suffixes that share `depth` bytes; intervals nest as the nodes of the suffix tree do.
    """
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    found, stack = [], [(0, 0)]  # depth, low
    for i in range(1, len(order) + 1):
        shared = common_length(suffixes[order[i - 1]], suffixes[order[i]]) if i < len(order) else 0
        low = i - 1
        while stack[-1][0] > shared:
            depth, low = stack.pop()
            if depth >= least:
                found.append((depth, low, i - 1))
        if stack[-1][0] < shared:
            stack.append((shared, low))
    return order, found


def repeated_windows(contexts: list[tuple[bytes, bytes, int, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each context (bytes before the anchor reversed, bytes from it on, lo, hi) the distances whose windows others have too.

    The suffixes from the anchor are sorted; in each interval of their common prefixes the members are told apart by
    what precedes them: neighbours in the order of the reversed left sides share the longest left extension. Where
    it differs between members the repeat cannot be extended for all, and each member's longest one ends its maximal
    repeat. A window at distance r is repeated if some interval has length - r bytes and a left extension of r.
    """
    if len(contexts) == 2:  # one interval with both members
        (left, right, *_), (other, follow, *_) = contexts
        low, high = length - common_length(right, follow), common_length(left, other)
        return [[(max(low, lo), min(high, hi))] if max(low, lo) <= min(high, hi) else [] for _, _, lo, hi in contexts]
    order, found = intervals([c[1] for c in contexts], length - max(c[3] for c in contexts))
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for depth, low, high in found:
        members = sorted(order[low : high + 1], key=lambda i: contexts[i][0])
        shared = [0, *(common_length(contexts[a][0], contexts[b][0]) for a, b in zip(members, members[1:], strict=False)), 0]
        for k, i in enumerate(members):
            _, _, lo, hi = contexts[i]
            least, most = max(length - depth, lo), min(max(shared[k], shared[k + 1]), hi)
            if least <= most:
                out[i].append((least, most))
    return out


SPANS = "doc_id bigint, h1 bigint, start int, end int"


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, h1, start, end (bytes) of spans all of whose bytes lie in repeated windows; together they cover every such byte.

    Runs whose anchor occurs once hold no repeats. Runs that are equal as a whole are repeated as a whole and count as
    one class. Only anchors with several classes need their contexts compared, one context a class. An anchor with
    more classes than `group` is never gathered: its contexts' windows are dealt by their hashes and counted.
    """
    rows = keyed(docs)
    runs = all_runs(rows, length, gram)
    several = written(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram"), "repeats-grams")
    runs = written(runs.join(several, "gram"), "repeats-runs")
    key = ["gram", "lo", "hi", "span"]
    classes = written(runs.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "h1", "at")).alias("one")), "repeats-classes")
    whole = runs.join(written(classes.where("c > 1").select(*key), "repeats-whole"), key).select("doc_id", "h1", (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + length).alias("end")).distinct()
    open_ = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    wanted = classes.join(written(open_, "repeats-open"), "gram").select("one.*", "gram", "lo", "hi", "size", (F.col("c") > 1).alias("known"))
    wanted = wanted.groupBy("doc_id", "h1").agg(F.collect_set(F.struct("at", "lo", "hi", "gram", "size", "known")).alias("w")).select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), "w")
    once = rows.join(wanted, rows.doc_id.eqNullSafe(F.col("_id")) & (rows.h1 == F.col("_h1"))).select("doc_id", "h1", "data", "w")
    cut = F.expr(f"substring(data, x.at - x.hi + 1, x.hi - x.lo + {length})")
    contexts = once.select("doc_id", "h1", "data", F.explode("w").alias("x")).select("doc_id", "h1", "x.gram", "x.at", "x.lo", "x.hi", "x.size", "x.known", cut.alias("data")).dropDuplicates(["doc_id", "h1", "gram", "at"])
    contexts = written(contexts, "repeats-contexts")
    few = contexts.where(F.col("size") <= group).drop("size").repartition(partitions(docs.sparkSession), "gram").sortWithinPartitions("gram")
    columns = ["gram", "doc_id", "h1", "at", "lo", "hi", "known", "data"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            found = repeated_windows([(data[: hi][::-1], data[hi:], lo, hi) for _, _, _, _, lo, hi, _, data in held], length) if len(held) > 1 else []
            for (_, doc_id, h1, at, _, _, known, _), own in zip(held, found, strict=False):
                if not known:
                    out.extend((doc_id, h1, at - most, at - least + length) for least, most in own)
            held.clear()

        def flush() -> pa.RecordBatch:
            cells = list(zip(*out, strict=True)) or [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "h1", "start", "end"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    close()
                held.append(row)
            if len(out) > 10_000:
                yield flush()
        if held:
            close()
        yield flush()

    near = few.select(*columns).mapInArrow(scan, SPANS)
    many = contexts.where(F.col("size") > group).select("gram", "doc_id", "h1", "at", "hi", "known", "data", F.explode(F.expr("sequence(lo, hi)")).alias("r"))
    many = many.select("gram", "doc_id", "h1", "at", "known", "r", F.sha2(F.expr(f"substring(data, hi - r + 1, {length})"), 256).alias("s"))
    twice = written(many.groupBy("gram", "r", "s").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "repeats-windows")
    hot = many.where("not known").join(twice, ["gram", "r", "s"]).select("doc_id", "h1", (F.col("at") - F.col("r")).alias("start"), (F.col("at") - F.col("r") + length).alias("end"))
    return whole.unionByName(near).unionByName(hot)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Contract columns for documents and kept (the bytes that stay).

    Null and empty texts, and those under `length` bytes, lose nothing. Copies of a document, repeated rows too, lose all
    that lies in repeats, the first one included, as the contract says. Other columns don't matter.
    """
    spans = repeated_spans(docs, length, gram, group).groupBy("doc_id", "h1").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    spans = written(spans.select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), "s"), "repeats-spans")
    rows = keyed(docs)
    rows = rows.join(spans, rows.doc_id.eqNullSafe(F.col("_id")) & (rows.h1 == F.col("_h1")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, data, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept, at, removed, count = [], 0, 0, 0
                for span in own or []:
                    if not count or span["start"] > at:
                        kept.append(data[at : span["start"]])
                        count += 1
                        removed += span["end"] - span["start"]
                        at = span["end"]
                    elif span["end"] > at:
                        removed += span["end"] - at
                        at = span["end"]
                kept.append(data[at:])
                rest = b"".join(kept)
                for column, value in zip(out, (doc_id, len(data), removed, count, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(),) * 4 + (pa.string(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.select("doc_id", "data", "s").mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
