"""Streaming ingest: layout files, status windows, re-deliveries, late supplements."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.identity import doi_in, journal
from ..operators.rewrites import cleaned


def documents(spark: SparkSession, path: str, schema) -> DataFrame:
    """New files of a folder of Parquet documents."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)


def cleaned_documents(stream: DataFrame, md: str = "md") -> DataFrame:
    """Per-text passes are expressions, so a stream takes them as a table does."""
    return stream.withColumns({"md": cleaned(F.col(md)), "doi": doi_in(F.col(md))}).withColumn("journal_slug", journal(F.col("doi")))


def first_deliveries(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def status_windows(stream: DataFrame, ts: str, status: str, width: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by tumbling or sliding window and status; rows later than ``late`` are left out."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), F.col(status).alias("status")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "status", "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _await(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    main, supplement = state.get if state.exists else (None, None)
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"base": [key[0]], "pdf": [main], "supplement": [None]}) if main else pd.DataFrame({"base": [key[0]], "pdf": [supplement], "supplement": [None]})
        return
    for part in rows:
        for pdf, is_si in zip(part["pdf"], part["is_supplement"], strict=True):
            main, supplement = (main, supplement or pdf) if is_si else (main or pdf, supplement)
    if main and supplement:
        if state.exists:
            state.remove()
        yield pd.DataFrame({"base": [key[0]], "pdf": [main], "supplement": [supplement]})
    else:
        state.update((main, supplement))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 3_600_000)


def awaited_supplements(stream: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Files ``base, pdf, is_supplement, ts`` -> pairs; a file whose partner doesn't come within an hour of event time goes alone."""
    by = stream.withWatermark(ts, late).groupBy("base")
    return by.applyInPandasWithState(_await, "base string, pdf string, supplement string", "main string, supplement string", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a Parquet table below ``folder``, and read it."""
    spark, schema = stream.sparkSession, stream.schema
    if mode == "append":
        out = stream.writeStream.format("parquet").option("path", f"{folder}/rows")
    else:  # each batch is the whole result

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/rows")

        out = stream.writeStream.foreachBatch(write)
    out.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def upsert_each_batch(stream: DataFrame, path: str, checkpoint: str):
    """Append every micro-batch to a Parquet table once: its number is a partition that a repeat overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
