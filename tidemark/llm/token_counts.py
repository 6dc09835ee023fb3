"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced where both chunks must agree."""

from __future__ import annotations

import bisect
import functools
import json
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .packing import SPLIT, default_vocabulary, library

#: Bytes from a chunk's start to the next one's, and bytes that neighbours share at first; both grow by WIDER where no splice is found.
STEP, OVERLAP, WIDER = 65_536, 1024, 8
#: Places offered in an overlap for a splice.
OFFERED = 16
#: A text is over the limit if it has more tokens.
LIMIT = 512
#: Distinct pieces whose counts a worker remembers, and the longest such piece.
REMEMBERED, LONGEST = 1 << 18, 64


def local_rules(path: str) -> list[str] | None:
    """The file's added tokens if its encoding is local, else None: then texts are encoded whole.

    Local: bytes pieces cut by SPLIT without normalisation, and added tokens that are found as plain strings, hold no
    white space, and cannot overlap each other or themselves.
    """
    if not path.endswith(".json"):
        return None
    model = json.load(open(path, encoding="utf-8"))
    cut, added = model.get("pre_tokenizer") or {}, model.get("added_tokens") or []
    names = [t["content"] for t in added]
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
    apart = not any(a.endswith(b[:n]) for a in names for b in names for n in range(1, len(b) + (a != b))) and not any(a != b and b in a for a in names for b in names)
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or model.get("normalizer") or model.get("post_processor"):
        return None
    return names if plain and apart and not any(c.isspace() for name in names for c in name) else None


class Unsure(Exception):
    """A text has code points that libraries may class differently."""


class Pieces(dict):
    """The library's token count of each piece, asked for once."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of = ids_of
        # code points that Unicode had not assigned when the oldest of the libraries' tables was made: they alone are
        # cut differently by SPLIT here and in the library (a test goes through all code points)
        free = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
        starts = [c for i, c in enumerate(free) if not i or free[i - 1] != c - 1]
        ends = [c for i, c in enumerate(free) if i + 1 == len(free) or free[i + 1] != c + 1]
        self.free = regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]")

    def __missing__(self, piece: str) -> int:
        if not piece.isascii() and self.free.search(piece):
            raise Unsure
        n = len(self.ids_of(piece))
        if len(self) < REMEMBERED and len(piece) <= LONGEST:
            self[piece] = n
        return n


@functools.cache
def counter(path: str):
    """A function from a text to the number of its tokens, as the file's library has it (.json: tokenizers, .model: sentencepiece); once for a worker.

    With local rules the tokens of a text are those of its pieces, so each distinct piece is encoded once while a
    bounded memory holds it; texts with an added token, or with code points of unsure class, are encoded whole.
    """
    if path.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(own.encode(text, num_threads=1))
    ids_of, added = library(path), local_rules(path)
    if added is None:
        return lambda text: len(ids_of(text))
    known, cut = Pieces(ids_of), regex.compile(SPLIT).findall
    special = regex.compile("|".join(map(regex.escape, added)) or "(?!)").search

    def count(text: str) -> int:
        if special(text):
            return len(ids_of(text))
        try:
            return sum(map(known.__getitem__, cut(text)))
        except Unsure:
            return len(ids_of(text))

    return count


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def must_cut(before: str, after: str) -> bool:
    """Whether every scan by SPLIT cuts between these two characters, whatever stands around them and wherever it began.

    No alternative of SPLIT has white space after other characters, a mark after a letter, or a letter beside a digit.
    Only characters that are of one class in the tables of Unicode 3.2 and of today are relied on.
    """
    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    a, b = (old(c)[0] if old(c)[0] == new(c)[0] else "?" for c in (before, after))
    if after in " \t\n\r\x0b\x0c":
        return a in "LNPS"
    return (a == "L" and b in "NPS") or (a == "N" and b in "LPS")


def offered(text: str, at: list[int], low: int, high: int, middle: int) -> list[int]:
    """Up to OFFERED character places of text, with byte places at[...] in (low, high), where every scan cuts: those from middle on first."""
    first, last = bisect.bisect_right(at, low), bisect.bisect_left(at, high)
    places = [i for i in range(max(first, 1), min(last, len(text))) if must_cut(text[i - 1], text[i])]
    return ([i for i in places if at[i] >= middle] + [i for i in reversed(places) if at[i] < middle])[:OFFERED]


CHUNK = "uid bigint, k bigint, n bigint, heads array<struct<at:bigint,n:bigint>>, tails array<struct<at:bigint,n:bigint>>"


def encoded_chunks(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """For each chunk (uid, k, start, last, data) its number of tokens, and for places offered in the overlaps with its neighbours the tokens before them.

    at is a byte place in the whole text. Only places where a token of this chunk begins and none reaches over are listed.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                data, start = row["data"], row["start"]
                skip = next((i for i, b in enumerate(data[:4]) if b & 0xC0 != 0x80), 0) if row["k"] else 0
                text = data[skip:].decode("utf-8", "ignore")
                spans = own.encode(text, add_special_tokens=False).offsets
                at, place = [], start + skip  # the byte place of each character
                for c in text:
                    at.append(place)
                    place += len(c.encode())
                begins = [a for a, _ in spans]

                def counted(low: int, high: int) -> list[dict]:
                    found = []
                    for i in offered(text, at, low, high, (low + high) // 2):
                        t = bisect.bisect_left(begins, i)
                        if t < len(spans) and begins[t] == i and (not t or spans[t - 1][1] <= i):
                            found.append({"at": at[i], "n": t})
                    return found

                end = start + len(data)
                heads = counted(start, start + overlap) if row["k"] else []
                tails = [] if row["last"] else counted(end - overlap, end)
                out.append({"uid": row["uid"], "k": row["k"], "n": len(spans), "heads": heads, "tails": tails})
            place = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_pylist(out, pa.schema([("uid", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("heads", place), ("tails", place)]))

    return chunks.mapInArrow(encode, CHUNK)


def spliced(chunks: DataFrame) -> DataFrame:
    """uid, n_tokens and failed from encoded chunks: neighbours are joined at a place where tokens begin in both.

    There every scan cuts, and both chunks hold the text before and after it far enough, so the left one's tokens
    before it and the right one's from it on are the whole text's. failed: some neighbours share no such place.
    """
    after = Window.partitionBy("uid").orderBy("k")
    c = chunks.withColumn("next", F.lead("heads").over(after)).withColumn("more", F.lead("k").over(after).isNotNull())
    c = c.withColumn("place", F.expr("get(filter(tails, x -> exists(next, y -> y.at = x.at)), 0).at"))
    at = lambda side: F.expr(f"get(filter({side}, x -> x.at = place), 0).n")
    own = F.when(F.col("more"), at("tails") - at("next")).otherwise(F.col("n"))
    return c.groupBy("uid").agg(F.sum(own).alias("n_tokens"), F.max(F.col("more") & F.col("place").isNull()).alias("failed"))


def resynchronised(rows: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """uid and n_tokens of rows (uid, n_bytes, text), a stored table of huge texts.

    Each text is cut into chunks that are dealt out by text and place, so that one huge text keeps many tasks busy.
    Texts whose chunks cannot be aligned are cut anew, with chunks and overlaps WIDER, until they can or are one chunk.
    """
    found, left = None, rows
    while True:
        own = left.withColumn("data", F.col("text").cast("binary"))
        last = F.greatest(F.lit(0), F.ceil((F.col("n_bytes") - overlap) / step) - 1).cast("long")
        parts = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.struct(k.alias("k"), (k * step).alias("start"), (k == last).alias("last"), F.substring(F.col("data"), (k * step + 1).cast("int"), F.lit(step + overlap)).alias("data")))
        chunks = own.select("uid", F.explode(parts).alias("part")).select("uid", "part.*").repartition("uid", "k")
        round_ = written(spliced(encoded_chunks(chunks, path, overlap)), "token-splices")
        done = round_.where(~F.col("failed")).select("uid", "n_tokens")
        found = done if found is None else found.unionByName(done)
        failed = round_.where("failed").select("uid")
        if failed.isEmpty():
            return found
        left, step, overlap = rows.join(failed, "uid", "left_semi"), step * WIDER, overlap * WIDER


def counted(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs.

    Null and empty texts have no tokens. Every row counts for itself: repeated rows, null and repeated doc_ids are
    rows like others, and an empty table stays empty. Other columns, whatever their names, don't matter.
    """
    path = vocabulary or default_vocabulary()
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    local = local_rules(path)
    if local is not None and max(map(len, local), default=0) * 8 > overlap:
        raise ValueError("an overlap must be longer than any added token")
    huge = F.col("n_bytes") > step + overlap if local is not None else F.lit(False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = counter(path)
        for batch in batches:
            counts = [n(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    every = rows.where(~huge).mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    if local is not None:
        large = written(rows.where(huge).withColumn("uid", F.monotonically_increasing_id()), "token-texts")
        every = every.unionByName(large.join(resynchronised(large, path, step, overlap), "uid").select("doc_id", "n_bytes", "n_tokens"))
    return every.withColumn("over_limit", F.col("n_tokens") > limit)
