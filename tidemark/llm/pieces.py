"""SentencePiece encoding and decoding by unigram Viterbi over a double-array trie."""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character scores below the least piece.
PENALTY = 10.0
#: Words that a worker keeps encoded, twice.
KEPT = 200_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Trie:
    """A double-array trie over UTF-8 bytes: from state s byte b leads to t = base[s] + b if check[t] == s; value[s] is a piece or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]) -> None:
        size = 1 << 17
        base, check, value = (np.full(size, fill, np.int32) for fill in (0, -1, -1))
        check[0] = 0
        keys = sorted(keys)
        work, hint = [(0, 0, len(keys), 0)], 1
        while work:
            state, low, high, depth = work.pop()
            if len(keys[low][0]) == depth:
                value[state] = keys[low][1]
                low += 1
            if low == high:
                continue
            edges: list[list[int]] = []  # byte, from, to
            for i in range(low, high):
                b = keys[i][0][depth]
                if not edges or edges[-1][0] != b:
                    edges.append([b, i, i])
                edges[-1][2] = i + 1
            start = hint
            while True:
                if start + 1024 > size:
                    base, check, value = (np.concatenate([a, np.full(size, fill, np.int32)]) for a, fill in ((base, 0), (check, -1), (value, -1)))
                    size *= 2
                fits = np.ones(512, bool)
                for b, _, _ in edges:
                    fits &= check[start + b : start + b + 512] < 0
                if fits.any():
                    start += int(fits.argmax())
                    break
                start += 512
            if start > hint + 4096:  # what lies below is nearly full
                hint = start - 2048
            base[state] = start
            for b, i, j in edges:
                check[start + b] = state
                work.append((start + b, i, j, depth + 1))
        self.base, self.check, self.value = base.tolist(), check.tolist(), value.tolist()


class Model:
    """Pieces with scores, and the two directions."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.prefix, self.squeeze = True, True
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 3:
                own = dict(fields(value))
                if own.get(2):
                    raise ValueError("character maps aren't supported; normalise the text before")
                self.prefix, self.squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
        self.scores = [s for _, s, _ in self.pieces]
        self.trie = Trie([(p.encode(), i) for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER) and p])
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.least = min((s for _, s, kind in self.pieces if kind == NORMAL), default=0.0) - PENALTY
        plain = [p.replace(MARK, " ").encode() for p, _, _ in self.pieces]
        self.plain = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else plain[i] for i, (p, _, kind) in enumerate(self.pieces)]
        # No piece has a marker after another character: then every word can be encoded by itself.
        self.cuts = not any(a != MARK and b == MARK for p, _, kind in self.pieces if kind in (NORMAL, USER) for a, b in zip(p, p[1:], strict=False))
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.kept: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def normalized(self, text: str) -> str:
        """Blanks as markers, one before the text; runs of blanks squeezed if the model says so."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def best(self, word: str) -> list[int]:
        """The ids of the best path. Ties: the piece that starts first, hence the longest last piece."""
        data = word.encode()
        n, base, check, value, scores = len(data), self.trie.base, self.trie.check, self.trie.value, self.scores
        end = len(check)
        score: list[float | None] = [None] * (n + 1)
        back, piece = [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        at = 0
        while at < n:
            here = score[at]
            lead = data[at]
            size = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
            single, state, i = False, 0, at
            while i < n:
                to = base[state] + data[i]
                if to >= end or check[to] != state or to == 0:
                    break
                state = to
                i += 1
                found = value[state]
                if found >= 0:
                    new = here + scores[found]
                    if score[i] is None or new > score[i]:
                        score[i], back[i], piece[i] = new, at, found
                    if i == at + size:
                        single = True
                if not base[state]:
                    break
            if not single:
                i = at + size
                new = here + self.least
                if score[i] is None or new > score[i]:
                    score[i], back[i], piece[i] = new, at, -1
            at += size
        ids: list[int] = []
        while n:
            if piece[n] >= 0:
                ids.append(piece[n])
            elif self.bytes:
                ids.extend(self.bytes[b] for b in reversed(data[back[n] : n]))
            else:
                ids.append(self.unknown)
            n = back[n]
        ids.reverse()
        return ids

    def encode(self, text: str) -> list[int]:
        whole = self.normalized(text)
        if not self.cuts:
            return self.best(whole)
        ids: list[int] = []
        kept = self.kept
        for word in self.words.findall(whole):
            own = kept.get(word)
            if own is None:
                own = self.older.get(word)
                if own is None:
                    own = self.best(word)
                if len(word) <= 64:
                    if len(kept) >= KEPT:  # what was used lately stays, in the older half
                        self.older, self.kept = kept, {}
                        kept = self.kept
                    kept[word] = own
            ids += own
        return ids

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, byte pieces as bytes (wrong sequences as U+FFFD), markers as blanks, without the one put before the text."""
        plain = self.plain
        text = b"".join([plain[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@functools.cache
def model(path: str) -> Model:
    """The model, built once for a worker; its size is that of its vocabulary."""
    return Model(open(path, "rb").read())


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every text. Null and empty texts have no ids; repeated rows are rows like others; other columns don't matter."""
    path = path or default_model()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                ids = [np.array(own.encode(t), np.int32) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and text of every array of ids (null: none)."""
    path = path or default_model()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                texts = [own.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, ids array<int>, text string")


def digested(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, n_bytes (ids of byte fallback), ids_sha256 (of the ids joined by commas) and decoded_sha256 of every text."""
    own = model(path or default_model())
    low, high = (min(own.bytes.values()), max(own.bytes.values())) if own.bytes else (1, 0)
    rows = decoded(encoded(docs, path), path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.size(F.filter("ids", lambda i: i.between(low, high))).cast("long").alias("n_bytes"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
