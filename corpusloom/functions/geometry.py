"""Boxes as four columns x0, y0, x1, y1 of a struct; malformed boxes are null and match nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(values: Column) -> Column:
    """An array of at least four numbers as a struct, else null."""
    return F.when(F.size(values) >= 4, F.struct(*(F.element_at(values, k + 1).cast("double").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1")))))


def adjacent(parent: Column, other: Column, tolerance: float = 60.0) -> Column:
    """Above or below within the tolerance, or beside each other."""
    above = (other["y1"] <= parent["y0"] + 0.5) & (parent["y0"] - other["y1"] <= tolerance)
    below = (other["y0"] >= parent["y1"] - 0.5) & (other["y0"] - parent["y1"] <= tolerance)
    overlap = F.least(parent["y1"], other["y1"]) > F.greatest(parent["y0"], other["y0"])
    return F.coalesce(above | below | overlap, F.lit(False))


def x_compatible(parent: Column, other: Column, page_width: float = 612.0, overlap_min: float = 0.4, gap_max: float = 50.0) -> Column:
    """Overlapping in x, as wide as the page, or beside with a small gap."""
    shared = F.greatest(F.lit(0.0), F.least(parent["x1"], other["x1"]) - F.greatest(parent["x0"], other["x0"]))
    wide = lambda b: F.greatest(F.lit(1.0), b["x1"] - b["x0"])
    gap = F.greatest(other["x0"] - parent["x1"], parent["x0"] - other["x1"])
    return F.coalesce((shared / wide(parent) >= overlap_min) | (shared / wide(other) >= overlap_min) | (wide(other) / max(1.0, page_width) > 0.6) | ((gap >= 0) & (gap < gap_max)), F.lit(False))


def vertical_gap(parent: Column, other: Column) -> Column:
    return F.when(other["y1"] <= parent["y0"], parent["y0"] - other["y1"]).when(other["y0"] >= parent["y1"], other["y0"] - parent["y1"]).otherwise(0.0)


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def sparse(chars: Column, width: Column, page_height: Column, least: float = 0.005) -> Column:
    """Too few characters for the page's area."""
    return chars / (width * page_height) < least


def rotated(b: Column, ratio: float = 2.5) -> Column:
    return height(b) / F.greatest(F.lit(1.0), b["x1"] - b["x0"]) > ratio


def flipped(b: Column, page_height: Column) -> Column:
    """From a bottom-left origin to a top-left one."""
    return F.struct(b["x0"].alias("x0"), (page_height - b["y1"]).alias("y0"), b["x1"].alias("x1"), (page_height - b["y0"]).alias("y1"))


def crop_side(caption: Column, page_width: Column, text_above: Column, text_below: Column) -> Column:
    """Where a caption's figure is: for a caption of 60 % of the page or more the side with less text, else its own column."""
    return F.when((caption["x1"] - caption["x0"]) < 0.6 * page_width, "column").when(text_above <= text_below, "above").otherwise("below")
