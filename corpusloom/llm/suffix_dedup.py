"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document with a smaller
id. All strings are judged on the input.

1. Anchors. In every ``LENGTH``-byte string the ``SEED``-byte substring with the least hash is an
   anchor. Equal strings have their anchors at equal places, so it is enough to compare suffixes
   that start at anchors: about one for each 15 bytes.
2. Each chunk of documents asks which of its anchor hashes other documents have too. Only those
   go on, with the bytes on both sides that strings over this anchor can reach. A chunk sends
   equal surroundings once, for its smallest document; its larger documents are then settled.
   (Within a chunk equal surroundings are told by a 64-bit hash beside that of the anchor, so that
   a long text that repeats itself costs little more than its anchors.)
3. Each bucket of the hash space takes its surroundings in ascending order of document, in
   batches. A batch gets a suffix array over the bytes from the anchor on, which is scanned
   together with the array of each existing level for matches that reach ``LENGTH`` bytes to the
   left and right; then it becomes a level itself, and levels of equal size class merge.
   Matches are found by comparing bytes, not hashes.
4. The answers, one bit for each string over an anchor, go back to the chunks, which remove bytes.

Null texts count as empty. A null id counts as larger than every other; rows with equal ids don't
remove anything from each other. Texts shorter than ``LENGTH`` bytes stay. An empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import chunks
from .common import mix64, partitions, stored, tidy

LENGTH, SEED = 50, 20
REACH = LENGTH - SEED  # bytes before an anchor that a string over it can reach
#: Entries of a bucket that are worked on at once, whole anchors at a time, and in one batch of these.
SLICE, BATCH = 1 << 17, 1 << 14
#: Bytes of an anchor's hash that are sent to find out whether others have it. Within a bucket, whose
#: size doesn't grow with the corpus, a wrong yes is one in a million, and only costs a comparison.
SHORT = 5
#: Bytes of text for each bucket.
BUCKET_BYTES = 32 << 20
_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
BLOCK = 1 << 17
POWERS = np.cumprod(np.r_[_U(1), np.full(BLOCK + 2 * LENGTH, BASE)])
INVERSES = np.cumprod(np.r_[_U(1), np.full(BLOCK + 2 * LENGTH, INVERSE)])


def _slide(a: np.ndarray, width: int, what) -> np.ndarray:
    """Minimum or maximum over every window."""
    n, out, have = len(a) - width + 1, a, 1
    while have * 2 <= width:
        out = what(out[:-have], out[have:])
        have *= 2
    return what(out[:n], out[width - have : width - have + n])[:n] if have < width else out[:n]


def rolling(data: np.ndarray, width: int):
    """Block by block, the place of a block and the hashes of the ``width`` bytes from each of its places on."""
    for at in range(0, len(data) - width + 1, BLOCK):
        part = data[at : at + BLOCK + width - 1]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(BYTES[part] * POWERS[: len(part)], out=sums[1:])
        yield at, mix64((sums[width:] - sums[:-width]) * INVERSES[: len(part) - width + 1])


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``SEED`` bytes from every place on."""
    out = np.empty(len(data) - SEED + 1, dtype=np.uint64)
    for at, h in rolling(data, SEED):
        out[at : at + len(h)] = h
    return out


def anchors_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of one text."""
    if len(data) < LENGTH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = seed_hashes(data)
    width = LENGTH - SEED + 1
    least = _slide(h, width, np.minimum)
    pad = np.zeros(width - 1, dtype=np.uint64)
    at = np.flatnonzero(h == _slide(np.r_[pad, least, pad], width, np.maximum))
    return at, h[at]


class Anchors:
    """All anchors of a chunk, in order: place in the chunk's bytes, hash, row."""

    def __init__(self, c: chunks.Chunk) -> None:
        places, hashes, rows = [], [], []
        for i in range(len(c.doc_ids)):
            at, h = anchors_of(c.data[c.ends[i] : c.ends[i + 1]])
            places.append(at + c.ends[i])
            hashes.append(h)
            rows.append(np.full(len(at), i, dtype=np.int32))
        none = np.zeros(0, dtype=np.int64)
        self.at, self.row = np.concatenate([none, *places]), np.concatenate([none.astype(np.int32), *rows])
        self.hash = np.concatenate([none.astype(np.uint64), *hashes])

    def asked(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes ordered by bucket and value, their buckets, and where each anchor's hash is."""
        values, where = np.unique(self.hash, return_inverse=True)
        bucket = chunks.bucket_of(mix64(values), buckets)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return values[order], bucket[order], back[where]

    def keep(self, those: np.ndarray) -> None:
        self.at, self.row, self.hash = self.at[those], self.row[those], self.hash[those]


#: Bytes of one record of surroundings: those before the anchor, those from it on, and how many of each are in the text.
BEFORE, AFTER = REACH, LENGTH
RECORD = BEFORE + AFTER + 2


def reach(c: chunks.Chunk, a: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes of the text there are before each anchor and from it on, as far as strings reach."""
    left = np.minimum(a.at - c.ends[a.row], BEFORE).astype(np.uint8)
    return left, np.minimum(c.ends[a.row + 1] - a.at, AFTER).astype(np.uint8)


def surroundings(c: chunks.Chunk, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(n, RECORD) bytes around some places; bytes outside the text are zero."""
    out = np.zeros((len(at), RECORD), dtype=np.uint8)
    padded = np.zeros(len(c.data) + BEFORE + AFTER, dtype=np.uint8)
    padded[BEFORE : BEFORE + len(c.data)] = c.data
    view = np.lib.stride_tricks.as_strided(padded, (len(c.data) + 1, BEFORE + AFTER), (1, 1))
    out[:, : BEFORE + AFTER] = view[at]
    place = np.arange(BEFORE + AFTER)
    edge = np.flatnonzero((left < BEFORE) | (right < AFTER))
    outside = (place < BEFORE - left[edge].astype(np.int64)[:, None]) | (place >= BEFORE + right[edge].astype(np.int64)[:, None])
    out[edge, : BEFORE + AFTER] *= ~outside
    out[:, -2], out[:, -1] = left, right
    return out


def classes(c: chunks.Chunk, a: Anchors, docs: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal surroundings of equal anchors: a class of each anchor, and the anchor of the smallest document of each class, classes in order of hash."""
    key = a.hash.copy()
    edge = (left < BEFORE) | (right < AFTER)
    for at, h in rolling(c.data, BEFORE + AFTER):
        lo, hi = np.searchsorted(a.at, [at + BEFORE, at + BEFORE + len(h)])
        key[lo:hi] ^= np.where(edge[lo:hi], _U(0), h[a.at[lo:hi] - BEFORE - at])
    edge = np.flatnonzero(edge)
    for some in np.split(edge, range(1 << 16, len(edge), 1 << 16)):
        key[some] = _folded(key[some], surroundings(c, a.at[some], left[some], right[some]))
    key = mix64(key)
    order = np.lexsort((docs, key, a.hash))
    k = key[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (a.hash[order][1:] != a.hash[order][:-1])
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def allowed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bit d is set if the string that starts d bytes before the anchor lies in the text."""
    low = np.maximum(LENGTH - right.astype(np.int64), 0)
    return np.where(low <= left, (_U(2) << left.astype(np.uint64)) - (_U(1) << low.astype(np.uint64)), _U(0)).astype(np.uint32)


def valid(records: np.ndarray) -> np.ndarray:
    return allowed(records[:, -2], records[:, -1])


def _words(records: np.ndarray) -> np.ndarray:
    words = np.zeros((len(records), -(-RECORD // 8) * 8), dtype=np.uint8)
    words[:, :RECORD] = records
    return words.view(np.uint64)


def _folded(key: np.ndarray, records: np.ndarray) -> np.ndarray:
    words = _words(records)
    for k in range(words.shape[1]):
        key = mix64(key ^ words[:, k])
    return key


def distinct(hashes: np.ndarray, records: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal surroundings of equal anchors: a class of each row, and the row with the smallest document of each class, classes in order of hash."""
    words, key = _words(records), _folded(hashes, records)
    order = np.lexsort((docs, key, hashes))
    k, w = key[order], words[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1]).any(axis=1) | (hashes[order][1:] != hashes[order][:-1])
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _common(words: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each row with the one before, from big-endian words; 0 for the first."""
    out = np.zeros(len(words), dtype=np.int64)
    if len(words) > 1:
        differ = words[1:] ^ words[:-1]
        same = np.zeros(len(words) - 1, dtype=np.int64)
        going = np.ones(len(words) - 1, dtype=bool)
        for k in range(words.shape[1]):
            d = differ[:, k]
            lead = np.full(len(d), 8, dtype=np.int64)
            for b in range(7, -1, -1):
                lead[(d >> _U(8 * (7 - b)) & _U(255)) != 0] = b
            same += np.where(going, lead, 0)
            going &= d == 0
        out[1:] = np.minimum(same, most)
    return out


def _big_endian(part: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(part), -(-part.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : part.shape[1]] = part
    return padded.view(">u8").astype(np.uint64)


class Level:
    """Surroundings in suffix-array order: by anchor, then by the bytes from it on."""

    def __init__(self, hashes: np.ndarray, records: np.ndarray, docs: np.ndarray) -> None:
        after = _big_endian(records[:, BEFORE : BEFORE + AFTER])
        order = np.lexsort((*(after[:, k] for k in range(after.shape[1] - 1, -1, -1)), hashes))
        self.hash, self.record, self.doc, self.after = hashes[order], records[order], docs[order], after[order]
        self.order = order

    def __len__(self) -> int:
        return len(self.hash)


def scan(a: Level, b: Level | None) -> np.ndarray:
    """For each entry of ``a``: the strings over its anchor that a smaller document of ``a`` or ``b`` has too."""
    if b is None:
        hashes, records, docs, after, own = a.hash, a.record, a.doc, a.after, np.arange(len(a))
    else:
        hashes, records, docs, after = (np.concatenate(x) for x in ((a.hash, b.hash), (a.record, b.record), (a.doc, b.doc), (a.after, b.after)))
        order = np.lexsort((*(after[:, k] for k in range(after.shape[1] - 1, -1, -1)), hashes))
        hashes, records, docs, after = hashes[order], records[order], docs[order], after[order]
        own = np.empty(len(order), dtype=np.int64)
        own[order] = np.arange(len(order))
        own = own[: len(a)]
    n = len(hashes)
    right = _common(after, AFTER)
    right[np.r_[True, hashes[1:] != hashes[:-1]]] = -1
    group = np.cumsum(right < 0) - 1
    alone = np.bincount(group)[group] < 2
    reversed_before = _big_endian(records[:, BEFORE - 1 :: -1] if BEFORE else records[:, :0])
    order = np.lexsort(tuple(reversed_before[:, k] for k in range(reversed_before.shape[1] - 1, -1, -1)))
    left = _common(reversed_before[order], BEFORE)
    ok = valid(records)
    out = np.zeros(n, dtype=np.uint32)
    for d in range(REACH + 1):
        run = np.cumsum(right < LENGTH - d)
        kind = np.empty(n, dtype=np.int64)
        kind[order] = np.cumsum(left < d) if d else 0
        rows = np.flatnonzero((ok >> np.uint32(d) & 1).astype(bool) & ~alone)
        if not len(rows):
            continue
        key = run[rows] * (n + 1) + kind[rows]
        by = np.argsort(key, kind="stable")
        key = key[by]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least = np.minimum.reduceat(docs[rows][by], start)
        least = np.repeat(least, np.diff(np.r_[start, len(key)]))
        hit = rows[by][least < docs[rows][by]]
        out[hit] |= np.uint32(1 << d)
    return out[own]


class LogIndex:
    """Levels of suffix arrays; a batch is scanned against each, then joins them."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def add(self, hashes: np.ndarray, records: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Masks of the batch's entries. All documents of earlier batches are smaller, or equal."""
        own = Level(hashes, records, docs)
        found = scan(own, None)
        for level in self.levels:
            found |= scan(own, level)
        out = np.empty(len(own), dtype=np.uint32)
        out[own.order] = found
        self.levels.append(own)
        while len(self.levels) > 1 and len(self.levels[-2]).bit_length() <= len(self.levels[-1]).bit_length():
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(Level(np.concatenate([a.hash, b.hash]), np.concatenate([a.record, b.record]), np.concatenate([a.doc, b.doc])))
        return out


def masks(hashes: np.ndarray, records: np.ndarray, docs: np.ndarray, batch: int = BATCH, most: int = SLICE) -> np.ndarray:
    """For each entry of a bucket, the strings over its anchor that a smaller document has too.

    Different anchors have nothing to do with each other, so slices of whole anchors follow one
    another, and memory is that of one slice beside the entries themselves.
    """
    order = np.argsort(hashes, kind="stable")
    ends = np.flatnonzero(np.diff(hashes[order])) + 1
    ends = np.r_[ends, len(order)]
    out, at = np.zeros(len(order), dtype=np.uint32), 0
    while at < len(order):
        till = int(ends[max(0, np.searchsorted(ends, at + most, side="right") - 1)])
        if till <= at:  # one anchor alone is larger
            till = int(ends[np.searchsorted(ends, at, side="right")])
        part = order[at:till]
        out[part] = _slice_masks(hashes[part], records[part], docs[part], batch)
        at = till
    return out


def _slice_masks(hashes: np.ndarray, records: np.ndarray, docs: np.ndarray, batch: int) -> np.ndarray:
    number, first = distinct(hashes, records, docs)
    out = np.where(docs > docs[first][number], valid(records), np.uint32(0))
    mine = first[np.argsort(docs[first], kind="stable")]
    index = LogIndex()
    found = np.zeros(len(hashes), dtype=np.uint32)
    for at in range(0, len(mine), batch):
        part = mine[at : at + batch]
        found[part] = index.add(hashes[part], records[part], docs[part])
    return out | np.where(docs == docs[first][number], found[first][number], np.uint32(0))


def _ask(buckets: int):
    def run(batches):
        for c, _ in chunks.rows_of(batches, ()):
            a = Anchors(c)
            values, bucket, where = a.asked(buckets)
            low, high = np.full(len(values), np.iinfo(np.int64).max), np.full(len(values), np.iinfo(np.int64).min)
            docs = c.order_ids()[a.row]
            np.minimum.at(low, where, docs)
            np.maximum.at(high, where, docs)
            several = low < high
            short = mix64(values).view(np.uint8).reshape(-1, 8)[:, :SHORT]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                part = slice(cut[k], cut[k + 1])
                blob = np.packbits(several[part]).tobytes() + short[part].tobytes()
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([c.number], pa.int64()), pa.array([cut[k + 1] - cut[k]], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "chunk", "n", "blob"])

    return run


def _shared(batches):
    for bucket, rows in chunks.by_bucket(batches):
        counts = [r[2] for r in rows]
        several = np.concatenate([np.unpackbits(np.frombuffer(r[3], np.uint8, -(-n // 8)), count=n) for r, n in zip(rows, counts, strict=True)]).astype(bool)
        short = np.concatenate([np.frombuffer(r[3], np.uint8, n * SHORT, -(-n // 8)).reshape(n, SHORT) for r, n in zip(rows, counts, strict=True)])
        values = np.zeros((len(short), 8), dtype=np.uint8)
        values[:, :SHORT] = short
        values = values.view(np.uint64).ravel()
        order = np.argsort(values, kind="stable")
        v = values[order]
        same = v[1:] == v[:-1]
        hit = several[order]
        hit[1:] |= same
        hit[:-1] |= same
        shared = np.empty(len(values), dtype=bool)
        shared[order] = hit
        at = 0
        for r, n in zip(rows, counts, strict=True):
            bits = np.packbits(shared[at : at + n]).tobytes()
            at += n
            yield pa.record_batch([pa.array([r[1]], pa.int64()), pa.array([bucket], pa.int32()), pa.array([bits], pa.binary())], names=["chunk", "bucket", "blob"])


def _wanted(c: chunks.Chunk, shared: list | None, buckets: int):
    """The shared anchors of a chunk, their surroundings, and which of these are sent, in order of bucket."""
    a = Anchors(c)
    values, bucket, where = a.asked(buckets)
    hit = np.zeros(len(values), dtype=bool)
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    for s in shared or []:
        lo, hi = cut[s["bucket"]], cut[s["bucket"] + 1]
        hit[lo:hi] = np.unpackbits(np.frombuffer(s["blob"], np.uint8), count=hi - lo)
    a.keep(hit[where])
    docs = c.order_ids()[a.row]
    left, right = reach(c, a)
    number, first = classes(c, a, docs, left, right)
    to = chunks.bucket_of(mix64(a.hash[first]), buckets)
    order = np.argsort(to, kind="stable")
    return a, left, right, docs, number, first, order, to[order]


def _send(buckets: int):
    def run(batches):
        for c, (shared,) in chunks.rows_of(batches, ("shared",)):
            a, left, right, docs, _, first, order, to = _wanted(c, shared, buckets)
            cut = np.searchsorted(to, np.arange(buckets + 1))
            mine = first[order]
            records = surroundings(c, a.at[mine], left[mine], right[mine])
            for k in np.flatnonzero(np.diff(cut)).tolist():
                pick = mine[cut[k] : cut[k + 1]]
                blob = chunks.squeezed(a.hash[pick].tobytes() + docs[pick].tobytes() + records[cut[k] : cut[k + 1]].tobytes())
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([c.number], pa.int64()), pa.array([len(pick)], pa.int64()), pa.array([blob], pa.binary())], names=["bucket", "chunk", "n", "blob"])

    return run


def _judge(batches):
    for bucket, rows in chunks.by_bucket(batches):
        hashes, docs, records = [], [], []
        for _, _, n, blob in rows:
            data = chunks.expanded(blob)
            hashes.append(np.frombuffer(data, np.uint64, n))
            docs.append(np.frombuffer(data, np.int64, n, 8 * n))
            records.append(np.frombuffer(data, np.uint8, n * RECORD, 16 * n).reshape(n, RECORD))
        sent = [(chunk, n) for _, chunk, n, _ in rows]
        rows.clear()
        whole = np.concatenate(records)
        records.clear()
        found = masks(np.concatenate(hashes), whole, np.concatenate(docs))
        at = 0
        for chunk, n in sent:
            blob = chunks.squeezed(found[at : at + n].tobytes())
            at += n
            yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], names=["chunk", "bucket", "blob"])


def removed(c: chunks.Chunk, shared: list | None, judged: list | None, buckets: int) -> np.ndarray:
    """Which bytes of a chunk go."""
    gone = np.zeros(len(c.data), dtype=bool)
    if not judged:
        return gone
    a, left, right, docs, number, first, order, to = _wanted(c, shared, buckets)
    sent = np.zeros(len(first), dtype=np.uint32)
    cut = np.searchsorted(to, np.arange(buckets + 1))
    for j in judged:
        sent[order[cut[j["bucket"]] : cut[j["bucket"] + 1]]] = np.frombuffer(chunks.expanded(j["blob"]), np.uint32)
    mask = np.where(docs > docs[first][number], allowed(left, right), sent[number])
    steps = np.zeros(len(c.data) + LENGTH + 1, dtype=np.int32)
    for d in range(REACH + 1):
        starts = a.at[(mask >> np.uint32(d) & 1).astype(bool)] - d
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + LENGTH, -1)
    return np.cumsum(steps[: len(c.data)]) > 0


def _cut(buckets: int, names: list[str]):
    def run(batches):
        for c, (shared, judged) in chunks.rows_of(batches, ("shared", "judged")):
            gone = removed(c, shared, judged, buckets)
            rest = c.rest() if names else None
            n = len(c.doc_ids)
            for at in range(0, n, 200):
                kept, texts, spans, sizes = [], [], [], []
                for i in range(at, min(n, at + 200)):
                    lo, hi = c.ends[i], c.ends[i + 1]
                    g = gone[lo:hi]
                    kept.append(c.data[lo:hi][~g].tobytes())
                    texts.append(kept[-1].decode("utf-8", "ignore"))
                    step = np.diff(np.r_[0, g.astype(np.int8), 0])
                    spans.append([{"start": s, "end": e} for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)])
                    sizes.append(int(hi - lo))
                own = [pa.array(c.doc_ids[at : at + 200], pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), pa.array(texts, pa.string())]
                more = [rest.column(x).slice(at, 200).combine_chunks() for x in names] if names else []
                more = [m.chunk(0) if isinstance(m, pa.ChunkedArray) else m for m in more]
                yield pa.record_batch([*own, *more], names=["doc_id", "n_bytes", "removed", "kept", "kept_text", *names])

    return run


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_bytes, removed array<struct<start,end>>, kept binary, kept_text`` and the ``rest`` columns for each row.

    ``removed`` are the maximal runs of removed bytes, as byte offsets into the text. ``kept_text``
    is ``kept`` without what is left of characters of which bytes were removed.
    """
    spark = df.sparkSession
    own = chunks.build(df, id_col, text_col, rest)
    buckets = max(partitions(spark), own.count() * chunks.CHUNK_BYTES // BUCKET_BYTES)
    asked = own.mapInArrow(tidy(_ask(buckets)), "bucket int, chunk bigint, n bigint, blob binary")
    shared = stored(chunks.spread(asked, buckets).mapInArrow(tidy(_shared), "chunk bigint, bucket int, blob binary"), "shared")
    known = own.join(chunks.answers(shared, "shared"), "chunk", "left")
    sent = known.mapInArrow(tidy(_send(buckets)), "bucket int, chunk bigint, n bigint, blob binary")
    judged = stored(chunks.spread(sent, buckets).mapInArrow(tidy(_judge), "chunk bigint, bucket int, blob binary"), "judged")
    whole = known.join(chunks.answers(judged, "judged"), "chunk", "left")
    schema = StructType.fromDDL("doc_id bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary, kept_text string")
    return whole.mapInArrow(tidy(_cut(buckets, list(rest))), StructType([*schema.fields, *(df.schema[c] for c in rest)]))
