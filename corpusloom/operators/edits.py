"""Edits and pending recoveries of a document, as keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["doc_id", "kind", "id"]


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` take the place of those with the same document, kind and id."""
    return old.join(new.select(*KEY).distinct(), KEY, "left_anti").unionByName(new, allowMissingColumns=True)


def dropped(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select(*KEY).distinct(), KEY, "left_anti")


def staged(pending: DataFrame, edits: DataFrame, new: DataFrame) -> DataFrame:
    """Stage recoveries, but none that was confirmed before."""
    return upserted(pending, new.join(edits.select(*KEY).distinct(), KEY, "left_anti"))


def promoted(pending: DataFrame, edits: DataFrame, confirmed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed pending rows move to the edits, with the columns of ``confirmed`` added: ``(pending, edits)``."""
    moved = pending.join(confirmed, KEY)
    return dropped(pending, confirmed), upserted(edits, moved)


def caption_line(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, kind, id, line``: the 1-based first line that captions a figure or table by its id, null if none does.

    ``lines``: ``doc_id, line_no, line`` with numbers from 0; ``wanted``: ``doc_id, kind, id``.
    """
    own = F.concat(F.lit(r"\Q"), F.col("id"), F.lit(r"\E"))
    table = F.concat(F.lit(r"(?i)^\s*\**\s*Table\s+"), own, F.lit(r"\b\s*[:.*|]"))
    figure = F.concat(F.lit(r"(?i)^\s*\**\s*(?:Extended\s+Data\s+)?Fig(?:ure|\.)\s+"), own, F.lit(r"\b"))
    hit = F.rlike(F.col("line"), F.when(F.col("kind") == "table", table).otherwise(figure))
    found = wanted.join(lines, "doc_id").where(hit).groupBy("doc_id", "kind", "id").agg((F.min("line_no") + 1).alias("line"))
    return wanted.join(found, ["doc_id", "kind", "id"], "left")
