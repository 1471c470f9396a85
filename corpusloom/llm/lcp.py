"""Document fingerprints by locally consistent parsing.

Each level renames runs of a symbol, colours the symbols by deterministic coin tossing (the
lowest bit in which a symbol differs from its left neighbour, and that bit; three rounds leave a
handful of colours) and begins a phrase at every local maximum of the colours. A phrase's name is
a hash of its symbols in order. Where a phrase begins depends only on a few neighbours, so equal
substrings get equal phrases inside, at any offset; only phrases near their ends can differ.

A fingerprint holds one-permutation minima of the phrase names of level 3 (about 27 bytes a
phrase) in 96 bins and of level 2 (about 9 bytes) in 32 bins, one byte a bin, zero for an empty
bin, as hex digits. ``likeness`` estimates the share of common phrases: by level 3, or by level 2
where two documents have too few phrases at level 3 to tell.

Null texts count as empty; an empty text has all bins empty, and is like another empty text by 1
and like any other text by 0. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions, tidy
from .ordering import bounds, range_of

BINS = {3: 96, 2: 32}
WIDTH = sum(BINS.values())
#: Bins of level 3 that must be in use, by either document, for level 3 to be trusted.
LEAST = 12
ROUNDS = 3
#: Bytes of text parsed at once.
CHUNK = 1 << 20

_U = np.uint64
SYMBOLS = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


def colours(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rounds of coin tossing; ``first`` marks where a document begins."""
    x = symbols
    for _ in range(ROUNDS):
        differ = x[1:] ^ x[:-1]
        one = differ.dtype.type(1)
        low = np.bitwise_count((differ & (~differ + one)) - one)
        low = np.minimum(low, np.uint8(x.dtype.itemsize * 8 - 1))
        out = np.empty(len(x), dtype=np.uint8)
        out[1:] = low * np.uint8(2) + (x[1:] >> low.astype(x.dtype) & one).astype(np.uint8)
        out[first] = (x[first] & one).astype(np.uint8)
        x = out
    return x


def phrases(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level's phrases, and the document of each."""
    start = np.r_[True, (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1])]
    at = np.flatnonzero(start)
    run = np.diff(np.r_[at, len(symbols)]).astype(np.uint64)
    symbols, doc = symbols[at], doc[at]
    long = run > 1
    symbols[long] = mix64(symbols[long] + run[long] * _U(0xA0761D6478BD642F))
    first = np.r_[True, doc[1:] != doc[:-1]]
    c = colours(symbols, first)
    begins = first.copy()
    if len(c) > 2:
        begins[1:-1] |= (c[1:-1] > c[:-2]) & (c[1:-1] > c[2:]) & ~first[2:]
    at = np.flatnonzero(begins)
    place = np.arange(len(symbols), dtype=np.uint64) - np.repeat(at, np.diff(np.r_[at, len(symbols)])).astype(np.uint64)
    return mix64(np.add.reduceat(mix64(symbols + (place + _U(1)) * _U(0xE7037ED1A0B428DB)), at)), doc[at]


def sketches(texts: list[bytes]) -> np.ndarray:
    """One row of bins for each text."""
    out = np.zeros((len(texts), WIDTH), dtype=np.uint8)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if not len(doc):
        return out
    symbols, side = SYMBOLS[np.frombuffer(b"".join(texts), dtype=np.uint8)], 0
    levels = {}
    for level in range(1, max(BINS) + 1):
        symbols, doc = phrases(symbols, doc)
        levels[level] = symbols, doc
    for level, bins in BINS.items():
        names, doc = levels[level]
        h = mix64(names + _U(level))
        key = doc.astype(np.uint64) * _U(bins) + (h >> _U(32)) % _U(bins)
        both = np.sort(key << _U(32) | h & _U(0xFFFFFFFF))
        key = both >> _U(32)
        new = np.r_[True, key[1:] != key[:-1]]
        row, place = np.divmod(key[new].astype(np.int64), bins)
        out[row, side + place] = (both[new] & _U(0xFFFFFFFF)) % _U(255) + _U(1)
        side += bins
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness, 0 to 1, of each row of bins to the other's same row."""
    same, used, side, found = (a == b) & (a > 0), (a > 0) | (b > 0), 0, {}
    for level, bins in BINS.items():
        s, u = same[:, side : side + bins].sum(axis=1), used[:, side : side + bins].sum(axis=1)
        found[level] = np.where(u > 0, np.maximum(0, (s / np.maximum(u, 1) - 1 / 255) / (1 - 1 / 255)), 1.0), u
        side += bins
    return np.where(found[3][1] >= LEAST, found[3][0], found[2][0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fingerprint string)`` for each row."""

    def run(batches):
        for b in batches:
            hexes, held = [], []
            for t in b.column(1).to_pylist():
                held.append((t or "").encode())
                if sum(map(len, held)) >= CHUNK:
                    hexes += [r.tobytes().hex() for r in sketches(held)]
                    held = []
            hexes += [r.tobytes().hex() for r in sketches(held)]
            yield pa.record_batch([b.column(0), pa.array(hexes, pa.string())], names=[id_col, "fingerprint"])

    src = df.select(id_col, text_col)
    return src.mapInArrow(tidy(run), f"`{id_col}` {src.schema[0].dataType.simpleString()}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as many code points from the start of the next document."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compare_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text, its edited text and its next document, in descending ``id_col`` order.

    The rows are dealt out by ranges of ids, so the texts move once; each range also gets the
    first document of the range after it. Equal ids are ordered by text; null ids come last.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = bounds(src, "doc_id", partitions(spark))
    n = len(cuts) + 1
    placed = src.withColumn("part", range_of("doc_id", cuts, descending=True))
    heads = {r[0]: r[1] for r in placed.groupBy("part").agg(F.max("doc_id")).collect()}
    full = sorted(heads)
    back = {p: full[i - 1] for i, p in enumerate(full)}
    head = F.array(*(F.lit(heads.get(p)).cast("bigint") for p in range(n)))
    before = F.array(*(F.lit(back.get(p, 0)) for p in range(n)))
    own = F.struct("part", F.lit(False).alias("tail"))
    copy = F.struct(F.get(before, F.col("part")).alias("part"), F.lit(True).alias("tail"))
    goes = F.when(F.col("doc_id").eqNullSafe(F.get(head, F.col("part"))), F.array(own, copy)).otherwise(F.array(own))
    dealt = placed.select("doc_id", "text", F.explode(goes).alias("to")).select("to.part", "to.tail", "doc_id", "text")
    ordered = dealt.repartitionById(n, "part").sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), "text")

    def compared(rows: list[tuple]):
        """All rows but the last, which is only the one after."""
        texts = [t for _, t in rows]
        edits = [edited(t, f) for t, f in zip(texts, texts[1:], strict=False)]
        data = [e.encode() for e in edits]
        plain, other = sketches([t.encode() for t in texts]), sketches(data)
        one = plain[:-1]
        yield pa.record_batch(
            [
                pa.array([d for d, _ in rows[:-1]], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in data]),
                pa.array([r.tobytes().hex() for r in one]),
                pa.array([r.tobytes().hex() for r in other]),
                pa.array(likeness(one, other)),
                pa.array(likeness(one, plain[1:])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches):
        part, rows, held, over = None, [], 0, False
        for b in batches:
            for p, tail, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    part, over = p, False
                if over:
                    continue
                rows.append((doc, text))
                held += len(text)
                if tail or held >= CHUNK and len(rows) > 1:
                    yield from compared(rows)
                    rows, held, over = ([], 0, True) if tail else (rows[-1:], len(text), False)

    return ordered.mapInArrow(tidy(run), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
