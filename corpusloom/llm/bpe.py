"""Byte-level BPE encoding and decoding.

A pre-token is merged with a rank queue: one bucket of linked-list positions for each merge
rank that is present, and a three-level bitmap over ranks whose find-first-set gives the next
rank. Entries that later merges made stale are skipped when they come up. A pre-token of n
bytes takes O(n log n) steps, so very long ones do no harm.

Null texts count as empty and encode to no ids. Rows are independent: repeated rows and ids
stay as they are, and other columns of the input are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import tidy

#: Distinct pre-tokens in each of the two generations that a worker remembers.
REMEMBERED = 300_000


class RankQueue:
    """Positions by rank; ``pop`` gives the lowest rank and in it the leftmost position."""

    __slots__ = ("buckets", "mid", "top", "words")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}  # bit of each rank, 64 ranks a word
        self.mid: dict[int, int] = {}  # bit of each word that isn't zero
        self.top = 0  # bit of each word of mid that isn't zero

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            word, high = rank >> 6, rank >> 12
            self.words[word] = self.words.get(word, 0) | 1 << (rank & 63)
            self.mid[high] = self.mid.get(high, 0) | 1 << (word & 63)
            self.top |= 1 << high
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        high = (self.top & -self.top).bit_length() - 1
        bits = self.mid[high]
        word = high << 6 | ((bits & -bits).bit_length() - 1)
        bits = self.words[word]
        rank = word << 6 | ((bits & -bits).bit_length() - 1)
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.words[word] &= self.words[word] - 1
            if not self.words[word]:
                self.mid[high] &= self.mid[high] - 1
                if not self.mid[high]:
                    self.top &= self.top - 1
        return rank, position


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    rank_at = [-1] * n
    queue = RankQueue()
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2], -1)
        if rank >= 0:
            rank_at[i] = rank
            queue.push(rank, i)
    while (found := queue.pop()) is not None:
        rank, i = found
        if rank_at[i] != rank:
            continue  # stale
        j = after[i]
        k = after[j]
        parts[i] += parts[j]
        parts[j], rank_at[j] = None, -1
        after[i] = k
        if k < n:
            before[k] = i
        for left, right in ((before[i], i), (i, k)):
            if left >= 0:
                rank_at[left] = new = ranks.get(parts[left] + parts[right], -1) if right < n else -1
                if new >= 0:
                    queue.push(new, left)
    return [ranks[p] for p in parts if p is not None]


class Codec(dict):
    """Pre-token -> its ids as little-endian int32 bytes, remembered.

    When the young generation is full it becomes the old one; what is still in use moves back.
    """

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__()
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.split = regex.compile(pattern).findall
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", merge(piece.encode(), self.ranks)).tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process; the file is part of the installed tokenizer package."""
    return Codec(path, pattern)


def encoded(texts, path: str, pattern: str):
    """An int32 array of ids for each text."""
    c = codec(path, pattern)
    for text in texts:
        yield np.frombuffer(c.encode(text), dtype="<i4") if text else np.zeros(0, dtype="<i4")


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)`` for each row."""

    def run(batches):
        for b in batches:
            ids = list(encoded(b.column(1).to_pylist(), path, pattern))
            ends = np.cumsum([0, *map(len, ids)]).astype("int32")
            flat = np.concatenate(ids) if ids else np.zeros(0, dtype="int32")
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=[id_col, "ids"])

    src = df.select(id_col, text_col)
    return src.mapInArrow(tidy(run), f"`{id_col}` {src.schema[0].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, decoded binary)`` for each row of ids; null ids decode to nothing."""

    def run(batches):
        for b in batches:
            c = codec(path, pattern)
            yield pa.record_batch([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], names=[id_col, "decoded"])

    src = df.select(id_col, ids_col)
    return src.mapInArrow(tidy(run), f"`{id_col}` {src.schema[0].dataType.simpleString()}, decoded binary")


def ids_and_text(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>, text string)`` for each row, the text decoded from the ids; one pass, so rows with equal or null ids stay apart."""

    def run(batches):
        for b in batches:
            c = codec(path, pattern)
            ids = list(encoded(b.column(1).to_pylist(), path, pattern))
            ends = np.cumsum([0, *map(len, ids)]).astype("int32")
            flat = np.concatenate(ids) if ids else np.zeros(0, dtype="int32")
            texts = [c.decode(x.tolist()).decode() for x in ids]
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())), pa.array(texts, pa.string())], names=[id_col, "ids", "text"])

    src = df.select(id_col, text_col)
    return src.mapInArrow(tidy(run), f"`{id_col}` {src.schema[0].dataType.simpleString()}, ids array<int>, text string")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode again in one pass: ``(id_col, n_tokens, ids_sha256, decoded_sha256)``."""

    def run(batches):
        for b in batches:
            c = codec(path, pattern)
            counts, digests, decodeds = [], [], []
            for ids in encoded(b.column(1).to_pylist(), path, pattern):
                ids = ids.tolist()
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                decodeds.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decodeds, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    src = df.select(id_col, text_col)
    return src.mapInArrow(tidy(run), f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
