"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Most rows and bytes of a batch that a function of Arrow batches gets; a longer row comes alone.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
#: Bytes up to which a table is dealt out to all cores.
SMALL_TABLE = 64 << 20
#: Removes the shuffle files of a job when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where that is unset, a temporary one serves a session whose executors run in the driver
    (``local[...]``); on a cluster it is an error, as a folder of one machine would lose tables.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            at = held.get()
        elif spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
            at = tempfile.mkdtemp(prefix="loom-")
            spark.sparkContext.setCheckpointDir(at)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at


def _folder(spark: SparkSession, path: str):
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """``stored``, dealt out by ``key``, so that joins by it needn't move the table. It is a table of the session's catalog, which goes with the application."""
    spark = df.sparkSession
    table = f"loom_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/loom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(partitions(spark), key).saveAsTable(table)
    finally:
        spark.conf.set(CLEANUP, before)
    files, of = _folder(spark, path)
    files.deleteOnExit(of)
    return spark.table(table)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts lineage for good.

    The table outlives a lost executor, unlike a cached or locally checkpointed one. The job's
    shuffle files go when it ends. The table goes by ``drop_stored``, or else with the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    files, of = _folder(spark, path)
    files.deleteOnExit(of)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote, once nothing reads them any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if "/loom-" in folder:
                files, of = _folder(df.sparkSession, folder)
                files.delete(of, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame) -> DataFrame:
    """Deal a table out to all cores if it is small; one file of it is one task otherwise. Larger ones have files enough."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_TABLE else df


def small(batches):
    """Cut Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES``."""
    for b in batches:
        left = [b]
        while left:
            b = left.pop()
            if b.num_rows > 1 and (b.num_rows > BATCH_ROWS or b.nbytes > BATCH_BYTES):
                left += [b.slice(b.num_rows // 2), b.slice(0, b.num_rows // 2)]
            else:
                yield b


def tidy(run):
    """A function of Arrow batches that gets small ones and gives its worker's free memory back when a partition is done.

    Workers stay for later tasks beside those of other stages; without this each keeps its peak.
    """

    def wrapped(batches):
        yield from run(small(batches))
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return wrapped


def crc_of_id(doc_id) -> int:
    """crc32 of the id in decimal; a null id counts as the text ``null``."""
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def hash_runs(values: np.ndarray, table: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``values``, which follow each other without gaps. Each place in a run has its own factor."""
    out = np.zeros(len(first), dtype=np.uint64)
    at = 0
    while at < len(first):  # some runs at a time, to stay in the cache
        to = max(at + 1, int(np.searchsorted(first, first[at] + (1 << 15))))
        a, b = int(first[at]), int(first[to - 1] + sizes[to - 1])
        place = np.arange(b - a) - np.repeat(first[at:to] - a, sizes[at:to])
        factor = (mix64(np.arange(5001, 5001 + int(sizes[at:to].max()), dtype=np.uint64)) | np.uint64(1))[place]
        out[at:to] = np.add.reduceat(table[values[a:b]] * factor, first[at:to] - a)
        at = to
    return mix64(out ^ sizes.astype(np.uint64))
