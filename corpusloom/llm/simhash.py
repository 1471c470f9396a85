"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into segments of 23, 23 and 18 bits (the last padded with
zeros to 23). The perfect binary Golay code covers the 23-bit words: every word lies within
three flips of exactly one codeword. A word's keys are all codewords within four flips of it;
any two words at most two flips apart share such a key. At most four differing bits over three
segments leave two segments with two flips or fewer, so two linked fingerprints share a pair of
keys in at least one pair of segments. Fingerprints with a common pair of keys are verified,
and each bucket hands on a spanning forest of its links, never all its pairs.

Null and empty texts, and texts without words, have fingerprint zero and link like any other.
Equal fingerprints are one node from the start, so groups of copies cost nothing to link.
Rows with a null id keep their fingerprint and link nothing; their component is that of the rows
with an equal fingerprint that have an id, or null without any.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, partitions, stored, tidy

SEED = 42
MOST_BITS = 4
SHINGLE = 4
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Bit set if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - n + 1].tolist()
    ends = (ends - 1)[n - 1 :].tolist()
    view = memoryview(joined)
    h = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts, ends, strict=True)), dtype=np.uint64, count=len(starts))
    most, ones = len(h) // 2, np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones > most, bitorder="little").view(np.uint64)[0])



def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndrome: the remainder of each 23-bit word by the generator."""
    r = words.copy()
    for bit in range(22, 10, -1):
        r ^= np.where(r >> bit & 1, GENERATOR << (bit - 11), 0)
    return r


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Error pattern of each syndrome; syndrome of each word's upper bits is linear, so a table of two halves."""
    errors = np.array([sum(1 << b for b in bits) for k in range(4) for bits in itertools.combinations(range(23), k)], dtype=np.int64)
    table = np.zeros(2048, dtype=np.int64)
    table[_remainder(errors)] = errors
    return table, _remainder(np.arange(1 << 12, dtype=np.int64) << 11)


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within three flips of each 23-bit word."""
    table, high = golay()
    return (words ^ table[high[words >> 11] ^ words & 2047]) >> 11


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices within four flips of each word, and which of them are there."""
    around = np.sort(np.stack([nearest(words), *(nearest(words ^ (1 << b)) for b in range(23))], axis=1), axis=1)
    new = np.ones(around.shape, dtype=bool)
    new[:, 1:] = around[:, 1:] != around[:, :-1]
    rows, _ = np.nonzero(new)
    place = np.cumsum(new, axis=1)[new] - 1
    out, there = np.zeros((len(words), 6), dtype=np.int64), np.zeros((len(words), 6), dtype=bool)
    out[rows, place], there[rows, place] = around[new], True
    return out, there


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the scrambled 26-bit bucket of every pair of keys of every fingerprint."""
    segments = [keys((fp >> np.uint64(lo) & np.uint64((1 << wide) - 1)).astype(np.int64)) for lo, wide in SEGMENTS]
    rows, buckets = [], []
    for number, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        (ka, ta), (kb, tb) = segments[a], segments[b]
        both = ta[:, :, None] & tb[:, None, :]
        key = ka[:, :, None] << 12 | kb[:, None, :] | number << 24
        rows.append(np.nonzero(both)[0])
        buckets.append(key[both])
    return np.concatenate(rows), np.concatenate(buckets)


def linked(fp: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (indices) of the links among one bucket's distinct fingerprints.

    Each member is compared with those not reached yet, so dense groups cost little.
    """
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= most
            if near.any():
                got, left = left[near], left[~near]
                a.append(np.full(len(got), x))
                b.append(got)
                front.extend(got.tolist())
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, dtype=np.int64),) * 2


def forest(key: np.ndarray, fp: np.ndarray, most: int = MOST_BITS, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices) within every bucket; ``key`` is sorted. Small buckets go all at once."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    a, b = [], []
    size_of = np.repeat(sizes, sizes)
    for shift in range(1, small):
        at = np.flatnonzero((size_of[:-shift] > shift) & (size_of[:-shift] <= small) & (key[:-shift] == key[shift:])) if len(key) > shift else np.zeros(0, dtype=np.int64)
        if len(at):
            at = at[np.bitwise_count(fp[at] ^ fp[at + shift]) <= most]
            a.append(at)
            b.append(at + shift)
    for start, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        x, y = linked(fp[start : start + size], most)
        a.append(x + start)
        b.append(y + start)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, dtype=np.int64),) * 2


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> (node, smallest node of its component within these edges)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """``(id_col, fp bigint)``; the bits of the unsigned fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, n) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    src = df.select(id_col, text_col)
    return src.mapInArrow(tidy(run), f"`{id_col}` {src.schema[0].dataType.simpleString()}, fp bigint")


def components(edges: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` of longs -> ``(a, root)``, root the smallest node reachable.

    Large-star and small-star rounds until nothing changes; each round is written to the
    shared folder. Only one count a round comes to the driver.
    """

    now = stored(edges.distinct(), "edges")
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = stored(small, "edges")
        same = new.exceptAll(now).limit(1).count() == 0 and now.exceptAll(new).limit(1).count() == 0
        drop_stored(now)
        now = new
        if same:
            return now.select("a", F.col("b").alias("root"))


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """``(id_col, fp bigint, component_id)`` for each row."""
    spark = df.sparkSession
    own = stored(fingerprints(df, id_col, text_col, n), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min(id_col).alias("node")).where("node is not null")

    def deal(batches):
        for b in batches:
            fp, node = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            rows, bucket = bucket_keys(fp.view(np.uint64))
            yield pa.record_batch([pa.array(bucket), pa.array(fp[rows]), pa.array(node[rows])], names=["bucket", "fp", "node"])

    def verify(batches):
        whole = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if whole:
            bucket, fp, node = (np.concatenate(x) for x in zip(*whole, strict=True))
            order = np.lexsort((fp, bucket))
            bucket, fp, node = bucket[order], fp[order].view(np.uint64), node[order]
            a, b = forest(bucket, fp, most)
            if len(a):
                x, root = roots(node[a], node[b])
                for at in range(0, len(x), 100_000):
                    yield pa.record_batch([pa.array(x[at : at + 100_000]), pa.array(root[at : at + 100_000])], names=["a", "b"])

    dealt = nodes.mapInArrow(tidy(deal), "bucket bigint, fp bigint, node bigint").repartition(4 * partitions(spark), "bucket")
    edges = dealt.mapInArrow(tidy(verify), "a bigint, b bigint").where("a <> b")
    joined = nodes.join(components(edges), nodes["node"] == F.col("a"), "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return own.join(joined, "fp", "left").select(id_col, "fp", "component_id")
