"""Bundles of a document's texts and assets, and what is on disk beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEPT = (".jpg", ".jpeg", ".png", ".md")


def kept_asset(name: Column) -> Column:
    """Images and markdown go into a bundle; other files are reported."""
    return F.lower(name).rlike(r"\.(jpg|jpeg|png|md)$")


def repacked(bundle: DataFrame, disk: DataFrame, now: Column) -> DataFrame:
    """Documents of a new bundle: markdown from disk only, metadata from disk or else from the old bundle.

    ``bundle`` has ``doc_id, meta, source_pdf, overall, grade, created_at, original_created_at``, ``disk``
    has ``doc_id, md, meta``. A document whose markdown isn't on disk is an error row.
    """
    b, d = bundle.alias("b"), disk.alias("d")
    both = b.join(d, F.col("b.doc_id") == F.col("d.doc_id"), "full")
    return both.select(
        F.coalesce("d.doc_id", "b.doc_id").alias("doc_id"),
        F.col("d.md").alias("md"),
        F.coalesce("d.meta", "b.meta").alias("meta"),
        F.col("b.source_pdf").alias("source_pdf"),
        F.col("b.overall").alias("overall"),
        F.col("b.grade").alias("grade"),
        now.alias("created_at"),
        F.coalesce("b.original_created_at", "b.created_at").alias("original_created_at"),
        F.when(F.col("d.md").isNull(), "markdown-missing-on-disk").alias("error"),
    )


def prefixed_assets(assets: DataFrame, prefix: str) -> DataFrame:
    """Copies of asset rows under names that can't collide with another document's."""
    return assets.withColumn("name", F.concat(F.lit(prefix), "name"))


def pdf_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
