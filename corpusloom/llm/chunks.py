"""Chunks of documents, and questions that chunks put to a table dealt out by hash.

A chunk holds the rows of a few megabytes of text as one row of a table in the shared folder. A
chunk sends each bucket of a hash space one blob with all its keys there, and gets one blob of
answers back, so what moves is a few bytes for each distinct key of a chunk, however often the
chunk holds it; hot keys are combined before they move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, stored, tidy

#: Bytes of text after which a chunk is closed.
CHUNK_BYTES = 8 << 20


def squeezed(data) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expanded(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Chunk:
    """Row numbers run from 0; ``ends`` are the byte offsets between texts, ``data`` all bytes."""

    def __init__(self, number: int, doc_ids: list, ends: bytes, texts: bytes, rest: bytes) -> None:
        self.number, self.doc_ids, self._rest = number, doc_ids, rest
        self.ends = np.frombuffer(ends, dtype="<i8")
        self.bytes = expanded(texts)
        self.data = np.frombuffer(self.bytes, dtype=np.uint8)

    def text(self, i: int) -> bytes:
        return self.bytes[self.ends[i] : self.ends[i + 1]]

    def rest(self) -> pa.Table:
        return pa.ipc.open_stream(expanded(self._rest)).read_all()

    def order_ids(self) -> np.ndarray:
        """Ids as integers; a null id counts as larger than all others."""
        top = np.iinfo(np.int64).max
        return np.array([top if d is None else d for d in self.doc_ids], dtype=np.int64)


COLUMNS = ("chunk", "doc_ids", "ends", "texts", "rest")


def build(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: tuple[str, ...] = (), size: int = CHUNK_BYTES) -> DataFrame:
    """Write the chunks of ``df``; null texts become empty ones. ``rest`` columns are carried along."""
    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c) for c in rest))

    def run(batches):
        part, number, docs, texts, others, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def chunk():
            ends = np.cumsum([0, *map(len, texts)]).astype("<i8").tobytes()
            sink = pa.BufferOutputStream()
            if others:
                with pa.ipc.new_stream(sink, others[0].schema) as out:
                    for o in others:
                        out.write_batch(o)
            cols = ((part << 32 | number, pa.int64()), (docs, pa.list_(pa.int64())), (ends, pa.binary()), (squeezed(b"".join(texts)), pa.binary()), (squeezed(sink.getvalue().to_pybytes()), pa.binary()))
            return pa.record_batch([pa.array([x], k) for x, k in cols], names=list(COLUMNS))

        for b in batches:
            own = pa.record_batch(b.columns[2:], names=list(rest)) if rest else None
            from_row = 0
            ids = b.column(0).to_pylist()
            for i, t in enumerate(b.column(1).to_pylist()):
                docs.append(ids[i])
                texts.append(t.encode())
                held += len(texts[-1])
                if held >= size:
                    if own is not None:
                        others.append(own.slice(from_row, i + 1 - from_row))
                    yield chunk()
                    from_row, number, docs, texts, others, held = i + 1, number + 1, [], [], [], 0
            if own is not None and from_row < len(ids):
                others.append(own.slice(from_row))
        if docs:
            yield chunk()

    return stored(dealt(src).mapInArrow(tidy(run), "chunk bigint, doc_ids array<bigint>, ends binary, texts binary, rest binary"), "chunks")


def rows_of(batches, columns: tuple[str, ...]):
    """The chunks of Arrow batches, each with the values of its further columns."""
    for b in batches:
        at = [b.schema.get_field_index(c) for c in (*COLUMNS, *columns)]
        for i in range(b.num_rows):
            own = [b.column(k)[i].as_py() for k in at]
            yield Chunk(*own[:5]), own[5:]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each well mixed 64-bit key, by its upper half."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def answers(df: DataFrame, name: str) -> DataFrame:
    """``(chunk, bucket, blob)`` rows -> ``(chunk, name)`` with the blobs of each chunk in order of bucket."""
    own = F.array_sort(F.collect_list(F.struct("bucket", "blob")))
    return df.groupBy("chunk").agg(own.alias(name))


def spread(asked: DataFrame, buckets: int, chunk_col: str = "chunk") -> DataFrame:
    """Deal question blobs out: one partition for each bucket, in order of chunk."""
    return asked.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", chunk_col)


def by_bucket(batches):
    """Rows sorted by their first column, as one list for each value of it."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[0] != now:
                yield now, held
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield now, held
