"""Token-id files with Elias-Fano document boundaries.

A file is one block: a header, the ids of the documents, the boundaries of the documents in the
concatenated id array in Elias-Fano form (low bits packed, high bits unary, a sample of select
positions) and the id array itself, in two bytes an id if the vocabulary allows, else four.
``Boundaries.select(i)`` gives the start of document i from one sample and a popcount scan, so no
table of 64-bit offsets is kept. Blocks are written as binary values of a Parquet table in a
folder that all executors share, in ascending document order; the table's other columns hold the
range, number and counts of each block.

Null texts count as empty: such a document has only the end id. Null ids come first. Repeated
rows stay, next to each other. An empty table gives an empty folder that reads back as no rows.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import mix64, partitions, stored, tidy
from .ordering import bounds, range_of

#: Ids in one block, beyond which the next begins.
BLOCK_IDS = 1 << 20
#: One select position is kept for each so many documents.
SAMPLED = 64
REMEMBERED = 500_000
#: Characters of text that are encoded together.
TOGETHER = 1 << 21
PLACED = mix64(np.arange(1, 257, dtype=np.uint64))
#: ASCII punctuation that never joins with a letter before it.
APART = np.isin(np.arange(256), np.frombuffer(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~', dtype=np.uint8))
BY_PLACE = mix64(np.arange(1001, 5097, dtype=np.uint64)) | np.uint64(1)
HEAD = struct.Struct("<4sBBHQQI")
MAGIC = b"LOOM"


class Boundaries:
    """Elias-Fano form of a non-decreasing sequence that starts at 0."""

    def __init__(self, count: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.count, self.width, self.low, self.high, self.samples = count, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> Boundaries:
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(width)[None, :] & 1).astype(np.uint8)
        at = (values >> width) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        high[at] = 1
        return cls(n, width, np.packbits(bits.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), at[::SAMPLED].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value: the place of the i-th set high bit, and its low bits."""
        at = int(self.samples[i // SAMPLED])
        left, byte = i % SAMPLED, at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        start = i * self.width
        chunk = int.from_bytes(self.low[start >> 3 : (start + self.width + 7) >> 3].tobytes(), "little")
        return place - i << self.width | chunk >> (start & 7) & (1 << self.width) - 1

    def all(self) -> np.ndarray:
        """Every value at once."""
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        low = np.unpackbits(self.low, bitorder="little")[: self.count * self.width].reshape(self.count, self.width).astype(np.int64)
        return (place - np.arange(self.count) << self.width) + (low << np.arange(self.width)).sum(axis=1)

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.count, self.width, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: memoryview) -> tuple[Boundaries, int]:
        count, width, lows, highs = struct.unpack_from("<QBQQ", data)
        at = struct.calcsize("<QBQQ")
        low = np.frombuffer(data, np.uint8, lows, at)
        high = np.frombuffer(data, np.uint8, highs, at + lows)
        samples = np.frombuffer(data, "<u4", -(-count // SAMPLED), at + lows + highs)
        return cls(count, width, low, high, samples), at + lows + highs + samples.nbytes


def pack(doc_ids: list, lengths: list[int], ids: bytes, id_bytes: int) -> bytes:
    """One block; ``ids`` are the concatenated ids of its documents."""
    there = np.packbits([d is not None for d in doc_ids], bitorder="little").tobytes()
    own = np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes()
    ends = Boundaries.of(np.cumsum([0, *lengths])).to_bytes()
    return HEAD.pack(MAGIC, 1, id_bytes, 0, len(doc_ids), sum(lengths), len(ends)) + own + there + ends + ids


def unpack(block: bytes) -> tuple[list, Boundaries, np.ndarray]:
    """Document ids, boundaries and id array of a block."""
    data = memoryview(block)
    magic, version, id_bytes, _, docs, total, ends = HEAD.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token-id block")
    at = HEAD.size
    own = np.frombuffer(data, "<i8", docs, at)
    at += own.nbytes
    there = np.unpackbits(np.frombuffer(data, np.uint8, -(-docs // 8), at), bitorder="little")[:docs]
    at += -(-docs // 8)
    found, _ = Boundaries.read(data[at : at + ends])
    ids = np.frombuffer(data, f"<u{id_bytes}", total, at + ends)
    return [d if ok else None for d, ok in zip(own.tolist(), there.tolist(), strict=True)], found, ids


class Words:
    """Encodes each piece of a text by the library once, and remembers it.

    The tokenizer drops white space before it merges, and begins anew where punctuation other
    than an apostrophe follows a letter, so pieces parted there don't interact. It composes
    characters and then folds case, so an ASCII letter may be folded first unless a character
    outside ASCII, which could be a combining mark, follows. The pieces of a batch are told apart by hash in numpy, and compared byte for byte with the
    one that stands for them.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.id_bytes = 2 if self.library.get_vocab_size(True) <= 1 << 16 else 4
        self.kind = f"<u{self.id_bytes}"
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def one(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def remember(self, piece: bytes, ids: bytes) -> None:
        if len(piece) <= 64:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[piece] = ids

    def of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces; those of letters only are sent to the library together, as one text."""
        out, letters = [], []
        for i, piece in enumerate(pieces):
            ids = self.young.get(piece)
            if ids is None:
                ids = self.old.get(piece)
                if ids is None:
                    text = piece.decode()
                    if text.isalpha():
                        letters.append((i, text))
                    else:
                        ids = self.one(text)
                if ids is not None:
                    self.remember(piece, ids)
            out.append(ids)
        for at in range(0, len(letters), 1000):
            part = letters[at : at + 1000]
            found = self.library.encode(" ".join(text for _, text in part), add_special_tokens=False)
            word = np.array(found.word_ids, dtype=np.int64)
            cut = np.searchsorted(word, np.arange(len(part) + 1)).tolist()
            whole = len(word) > 0 and int(word[-1]) == len(part) - 1
            ids = np.array(found.ids, dtype=self.kind)
            for k, (i, text) in enumerate(part):
                out[i] = ids[cut[k] : cut[k + 1]].tobytes() if whole else self.one(text)
                self.remember(pieces[i], out[i])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        own = [any(a in t for a in self.added) for t in texts]
        if any(own):
            rest = iter(self.encode([t for t, x in zip(texts, own, strict=True) if not x]))
            return [self.one(t) if x else next(rest) for t, x in zip(texts, own, strict=True)]
        if not texts:
            return []
        data = np.frombuffer(" ".join(texts).encode() + b" ", dtype=np.uint8).copy()
        upper = (data[:-1] - 65 < 26) & (data[1:] < 128)
        data[:-1][upper] += 32
        there = data != 32
        begins = there.copy()
        begins[1:] &= ~there[:-1] | APART[data[1:]] & (data[:-1] - 97 < 26)
        counts = np.cumsum([len(t.encode()) + 1 for t in texts])
        letters, begins = data[there], np.flatnonzero(begins)
        owner = np.searchsorted(counts, begins, side="right")
        lengths = np.zeros(len(texts), dtype=np.int64)
        if not len(begins):
            return [b""] * len(texts)
        first = (np.cumsum(there) - 1)[begins]
        sizes = np.diff(np.r_[first, len(letters)])
        joined = letters.tobytes()
        place = np.arange(len(letters)) - np.repeat(first, sizes)
        h = mix64(np.add.reduceat(PLACED[letters] * BY_PLACE[place % len(BY_PLACE)], first))
        _, rep, inverse = np.unique(h, return_index=True, return_inverse=True)
        stands = rep[inverse]
        same = (sizes[stands] == sizes).all() and bool((letters == letters[np.repeat(first[stands], sizes) + place]).all())
        if not same:
            rep = inverse = np.arange(len(first))
        values = self.of([joined[a : a + n] for a, n in zip(first[rep].tolist(), sizes[rep].tolist(), strict=True)])
        width = np.array([len(v) for v in values]) // self.id_bytes
        flat = np.frombuffer(b"".join(values), dtype=self.kind)
        own = width[inverse]
        np.add.at(lengths, owner, own)
        till = np.cumsum(own)
        ids = flat[np.repeat((np.cumsum(width) - width)[inverse] - (till - own), own) + np.arange(int(till[-1]))].tobytes()
        cut = (np.cumsum(np.r_[0, lengths]) * self.id_bytes).tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]


@functools.cache
def words(path: str) -> Words:
    """One for each worker process."""
    return Words(path)


def encode(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids binary)``, each document closed by ``end_id``; the other columns that ``df`` has beside these two come first."""
    rest = [c for c in df.columns if c not in (id_col, text_col)]

    def run(batches):
        for b in batches:
            own = words(path)
            end = np.array([end_id], dtype=own.kind).tobytes()
            ids, held, size = [], [], 0
            for t in b.column(len(rest) + 1).to_pylist():
                held.append(t or "")
                size += len(held[-1])
                if size >= TOGETHER:
                    ids += own.encode(held)
                    held, size = [], 0
            ids = [i + end for i in ids + own.encode(held)]
            yield pa.record_batch([*b.columns[: len(rest) + 1], pa.array(ids, pa.binary())], names=[*rest, id_col, "ids"])

    src = df.select(*rest, id_col, text_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[: len(rest) + 1])
    return src.mapInArrow(tidy(run), f"{kinds}, ids binary")


def write(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every document's ids in ascending ``id_col`` order; returns the table of blocks as it was written."""
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    cuts = bounds(src, "doc_id", partitions(spark))
    dealt = encode(src.withColumn("part", range_of("doc_id", cuts)), path, end_id, "doc_id", "text")
    id_bytes = words(path).id_bytes

    def blocks(batches):
        part, number, before, docs, lengths, ids, held = None, 0, 0, [], [], [], 0

        def block():
            data = pack(docs, lengths, b"".join(ids), id_bytes)
            return pa.record_batch([pa.array([x], k) for x, k in ((part, pa.int32()), (number, pa.int32()), (before, pa.int64()), (len(docs), pa.int64()), (held, pa.int64()), (data, pa.binary()))], names=["part", "number", "before", "n_docs", "n_ids", "block"])

        for b in batches:
            for p, doc, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if docs and (p != part or held >= BLOCK_IDS):
                    yield block()
                    number, before = number + 1, before + held
                    docs, lengths, ids, held = [], [], [], 0
                if p != part:
                    part, number, before = p, 0, 0
                docs.append(doc)
                lengths.append(len(own) // id_bytes)
                ids.append(own)
                held += lengths[-1]
        if docs:
            yield block()

    ordered = dealt.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first())
    return stored(ordered.mapInArrow(tidy(blocks), "part int, number int, before bigint, n_docs bigint, n_ids bigint, block binary"), "ids")


def starts_of_parts(blocks: DataFrame) -> dict[int, int]:
    """Ids before each range; as many entries as there are ranges."""
    out, total = {}, 0
    for part, n in sorted((r[0], r[1]) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect()):
        out[part] = total
        total += n
    return out


def read(blocks: DataFrame) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``."""
    first = starts_of_parts(blocks)

    def run(batches):
        for b in batches:
            for part, before, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                docs, ends, ids = unpack(block)
                at = ends.all()
                crcs = [zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4").tobytes()) for i in range(len(docs))]
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(at[:-1] + (first[part] + before)), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "before", "block").mapInArrow(tidy(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
