"""Corpus runs: supplements, manifests, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import FAILURES
from ..functions.text import cascade

_SUPPLEMENT = r"(?i)^(.+?)[-_](?:SI|SM|supp|suppl|supplement|supplemental|supplementary|S\d+)$"
_MAIN = r"(?i)^(.+?)[-_](?:maintext|manuscript|paper|main)$"


def failure_kind(log: Column) -> Column:
    return F.coalesce(cascade(log, FAILURES), F.lit("unknown"))


def log_tail(log: Column, lines: int = 50) -> Column:
    return F.array_join(F.slice(F.split(log, "\n"), -F.least(F.size(F.split(log, "\n")), F.lit(lines)), F.lit(lines)), "\n")


def paired(files: DataFrame) -> DataFrame:
    """``stem`` of every file -> ``pdf, supplement, role``: mains with their first supplement, its further ones, and supplements without a main."""
    si = files.where(F.col("stem").rlike(_SUPPLEMENT)).select(F.col("stem").alias("si"), F.lower(F.regexp_extract("stem", _SUPPLEMENT, 1)).alias("base"))
    mains = files.where(~F.col("stem").rlike(_SUPPLEMENT)).select("stem", F.lower(F.when(F.col("stem").rlike(_MAIN), F.regexp_extract("stem", _MAIN, 1)).otherwise(F.col("stem"))).alias("base"))
    first = si.groupBy("base").agg(F.min("si").alias("supplement"))
    orphans = si.join(mains.select("base"), "base", "left_anti").select(F.col("si").alias("pdf"), F.lit(None).cast("string").alias("supplement"), F.lit("orphan-supplement").alias("role"))
    further = si.join(first, "base").where("si <> supplement").join(mains.groupBy("base").agg(F.min("stem").alias("stem")), "base").select(F.col("stem").alias("pdf"), F.col("si").alias("supplement"), F.lit("further-supplement").alias("role"))
    return mains.join(first, "base", "left").select(F.col("stem").alias("pdf"), "supplement", F.lit("main").alias("role")).unionByName(further).unionByName(orphans)


def statuses(runs: DataFrame, threshold: float = 0.7, deadline: float = 3600.0) -> DataFrame:
    """Manifest rows from ``pdf, exists, elapsed_sec, error, si_attempted, si_error, overall``: a supplement's failure leaves its main's status alone, and after a main's failure none is tried."""
    status = F.when(F.col("exists"), "skipped").when(F.col("elapsed_sec") > deadline, "timeout").when(F.col("error").isNotNull(), "error").when(F.col("overall") < threshold, "low_quality").otherwise("ok")
    failed = status.isin("error", "timeout")
    si = F.when(~failed & F.col("si_attempted") & (status != "skipped"), F.when(F.col("si_error").isNotNull(), "error").otherwise("ok"))
    return runs.select("pdf", status.alias("status"), F.when(status == "error", failure_kind(F.col("error"))).alias("error_kind"), si.alias("si_status"), F.when(si == "error", failure_kind(F.col("si_error"))).alias("si_error_kind"), F.bround("overall", 3).alias("overall"), F.bround("elapsed_sec", 1).alias("elapsed_sec"))


def status_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("elapsed_sec") / 3600, 4).alias("hours"))


def failure_groups(manifest: DataFrame) -> DataFrame:
    """How many files failed for each reason; ``failed_files`` has the files."""
    return manifest.where("status = 'error'").groupBy("error_kind").agg(F.count("*").alias("n"))


def failed_files(manifest: DataFrame) -> DataFrame:
    return manifest.where("status = 'error'").select("error_kind", "pdf")


def work_list(manifest: DataFrame) -> DataFrame:
    """What to look at again, and why."""
    why = F.array_compact(F.array(F.when(F.col("status").isin("error", "timeout"), F.col("status")), F.when(F.col("status") == "low_quality", "low_quality"), F.when(F.col("si_status") == "error", "supplement"), F.when(F.coalesce("figure_mismatch", F.lit(False)), "figures"), F.when(F.coalesce("table_mismatch", F.lit(False)), "tables")))
    return manifest.withColumn("why", F.array_join(why, "+")).where("why <> ''").select("pdf", "why")


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files without an output yet: resume by anti join."""
    return files.join(done.select("pdf").distinct(), "pdf", "left_anti")


def packages(rows: DataFrame) -> DataFrame:
    """``run, name, version`` -> ``run`` and a map of the versions that are known, names in order."""
    known = rows.where(F.col("version").isNotNull()).groupBy("run", "name").agg(F.max("version").alias("version"))
    return known.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "version")))).alias("packages"))
