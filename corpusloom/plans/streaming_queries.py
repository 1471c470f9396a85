"""Streaming queries, run over what is there and then ended."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import ingest
from .registry import query, table


def _folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one, ``spark.checkpoint.dir``; where that is unset, a temporary one serves a local session, and a cluster is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="loom-stream-")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)


@query("select time_bucket(interval '1 hour', cast(ts as timestamp)) as start, event_type as status, count(*) as n from events group by all")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts by hour, as a stream that ends."""
    out = ingest.status_windows(_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour", late="3650 days")
    return ingest.drained(out, _folder(spark), mode="complete").select("start", "status", "n")


@query("select event_type as status, count(*) as n from events group by event_type")
def event_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-delivered events count once."""
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = ingest.first_deliveries(e.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))), "event_id", "ts", "3650 days")
    return ingest.drained(twice.select("event_type"), _folder(spark)).groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
