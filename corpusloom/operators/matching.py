"""Matching two sources: figures, tables, captions, truth sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_column_name

LEAST_JACCARD = 0.30


def spliced_figures(left: DataFrame, right: DataFrame) -> DataFrame:
    """Captions ``doc_id, figure, line_no`` against images ``doc_id, figure, path, words``: full outer join on document and figure.

    The first image of a figure is spliced (1.0, or 0.7 for a caption under five words), more of
    them are dropped (0.6), images without a caption go to the end of the document, captions
    without an image are counted as left alone.
    """
    own = left.groupBy("doc_id", "figure").agg(F.min("line_no").alias("line_no"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "figure").orderBy("path"))
    both = own.join(right.withColumn("nth", nth), ["doc_id", "figure"], "full")
    where = F.when(F.col("path").isNull(), "left-only").when(F.col("line_no").isNull(), "end-of-document").when(F.col("nth") > 1, "duplicate").otherwise("spliced")
    score = F.when(where == "spliced", F.when(F.col("words") < 5, 0.7).otherwise(1.0)).when(where == "duplicate", 0.6).when(where == "end-of-document", 1.0)
    return both.select("doc_id", "figure", "line_no", "path", where.alias("placed"), score.alias("score"))


def inferred_pairs(captions: DataFrame, images: DataFrame) -> DataFrame:
    """Left-over captions ``doc_id, line_no, figure`` and images ``doc_id, page_idx, idx, path``, one to one in order where a document has as many of both (0.85)."""

    def ranked(df: DataFrame, *order: str) -> DataFrame:
        w = Window.partitionBy("doc_id")
        return df.withColumns({"rank": F.row_number().over(w.orderBy(*order)), "n": F.count("*").over(w)})

    return ranked(captions, "line_no", "figure").join(ranked(images, "page_idx", "idx"), ["doc_id", "rank", "n"]).select("doc_id", "figure", "line_no", "path", F.lit(0.85).alias("score"))


def recoverable_tables(referenced: DataFrame, inserted: DataFrame, extracted: DataFrame) -> DataFrame:
    """Tables ``doc_id, table_id`` referred to, not inserted, but extracted (first block): canonical ids on all sides."""
    missing = referenced.select("doc_id", "table_id").distinct().join(inserted.select("doc_id", "table_id").distinct(), ["doc_id", "table_id"], "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id", "table_id").orderBy("page_idx", "idx"))
    return missing.join(extracted.withColumn("nth", first).where("nth = 1").drop("nth"), ["doc_id", "table_id"])


def resolved_paths(wanted: DataFrame, files: DataFrame, folders: tuple[str, ...] = ("assets/", "images/", "auto/images/", "")) -> DataFrame:
    """``doc_id, name`` -> the first of its possible paths that ``files (path)`` has, null if none."""
    tried = wanted.select("doc_id", "name", F.posexplode(F.array(*(F.concat(F.lit(f), "name") for f in folders))).alias("rank", "path"))
    found = tried.join(files.select("path").distinct(), "path", "left_semi").groupBy("doc_id", "name").agg(F.min_by("path", "rank").alias("path"))
    return wanted.join(found, ["doc_id", "name"], "left")


def asset_near_caption(captions: DataFrame, images: DataFrame, reach: int = 8) -> DataFrame:
    """For each caption line the image line within ``reach`` lines: the nearest one before it, else the nearest after."""
    near = captions.alias("c").join(images.alias("i"), F.col("c.doc_id") == F.col("i.doc_id")).where(F.abs(F.col("i.line_no") - F.col("c.line_no")) <= reach)
    away = F.struct(F.col("i.line_no") > F.col("c.line_no"), F.abs(F.col("i.line_no") - F.col("c.line_no")))
    return near.groupBy(F.col("c.doc_id").alias("doc_id"), F.col("c.line_no").alias("line_no")).agg(F.min_by("i.href", away).alias("href"))


def caption_for_table(tables: DataFrame, captions: DataFrame, before: int = 800, after: int = 200) -> DataFrame:
    """Tables ``doc_id, start, end`` with the caption offset and id nearest above within ``before`` characters, else the first below within ``after``."""
    near = tables.alias("t").join(captions.alias("c"), F.col("t.doc_id") == F.col("c.doc_id")).where(F.col("c.off").between(F.col("t.start") - before, F.col("t.end") + after))
    below = F.col("c.off") >= F.col("t.start")
    rank = F.struct(below, F.when(below, F.col("c.off")).otherwise(-F.col("c.off")))
    return near.groupBy(F.col("t.doc_id").alias("doc_id"), F.col("t.start").alias("start")).agg(F.min_by(F.struct(F.col("c.off").alias("off"), F.col("c.table_id").alias("table_id")), rank).alias("x")).select("doc_id", "start", "x.*")


def caption_page(mentions: DataFrame) -> DataFrame:
    """Page of each caption from ``doc_id, label, page, leading``: the first where it begins a line, else the first at all."""
    return mentions.groupBy("doc_id", "label").agg(F.min(F.struct((~F.col("leading")).alias("inline"), "page")).alias("x")).select("doc_id", "label", "x.page")


def figure_benchmark(truth: DataFrame, run: DataFrame) -> DataFrame:
    """Per condition and paper, per condition, and over all: expected, right, wrong, missed, extra, duplicates, accuracy.

    ``truth``: ``paper, filename, expected`` (an id, DROP, or TODO, which is left out); ``run``:
    ``condition, paper, filename, matched_figure, dropped``.
    """
    known = truth.where("expected <> 'TODO'")
    conditions = run.select("condition", "paper").distinct()
    both = conditions.join(known, "paper").join(run, ["condition", "paper", "filename"], "left")
    right = F.when(F.col("expected") == "DROP", F.coalesce("dropped", F.lit(False))).otherwise(F.coalesce(F.col("matched_figure") == F.col("expected"), F.lit(False)))
    missed = F.col("dropped").isNull()
    extra = run.join(truth.select("paper", "filename"), ["paper", "filename"], "left_anti").select("condition", "paper", F.lit(0).alias("expected"), F.lit(0).alias("right"), F.lit(0).alias("missed"), F.lit(1).alias("extra"), F.lit(0).alias("duplicate"))
    again = F.row_number().over(Window.partitionBy("condition", "paper", "matched_figure").orderBy("filename"))
    twice = run.where("matched_figure is not null and not coalesce(dropped, false)").withColumn("nth", again).where("nth > 1").select("condition", "paper", F.lit(0).alias("expected"), F.lit(0).alias("right"), F.lit(0).alias("missed"), F.lit(0).alias("extra"), F.lit(1).alias("duplicate"))
    rows = both.select("condition", "paper", F.lit(1).alias("expected"), right.cast("int").alias("right"), missed.cast("int").alias("missed"), F.lit(0).alias("extra"), F.lit(0).alias("duplicate")).unionByName(extra).unionByName(twice)
    sums = rows.rollup("condition", "paper").agg(*(F.sum(c).alias(c) for c in ("expected", "right", "missed", "extra", "duplicate")))
    return sums.select(F.coalesce("condition", F.lit("ALL")).alias("condition"), F.coalesce("paper", F.lit("ALL")).alias("paper"), "expected", "right", "missed", "extra", "duplicate", F.round(F.try_divide("right", "expected"), 4).alias("accuracy"))


def column_jaccard(a, b):
    x, y = (F.array_distinct(F.transform(c, normal_column_name)) for c in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def _assign(pairs: pd.DataFrame) -> pd.DataFrame:
    """Truth tables in order take their best extracted table that is still free."""
    used, rows = set(), []
    for _, mine in pairs.sort_values(["table_id", "jaccard", "number"], ascending=[True, False, True], kind="stable").groupby("table_id", sort=True):
        free = mine[~mine["number"].isin(used)]
        if len(free):
            rows.append(free.iloc[0])
            used.add(free.iloc[0]["number"])
    return pd.DataFrame(rows, columns=pairs.columns)


def table_benchmark(truth: DataFrame, run: DataFrame) -> DataFrame:
    """``paper, table_id, number, jaccard, rows_ok``: truth tables and extracted ones of the same page, best column overlap of at least 0.30 first, none used twice.

    Turns depend on one another within a paper, whose few pairs go through one function.
    """
    pairs = truth.alias("t").join(run.alias("r"), (F.col("t.paper") == F.col("r.paper")) & (F.col("t.page") == F.col("r.page")))
    scored = pairs.select(F.col("t.paper").alias("paper"), F.col("t.table_id").alias("table_id"), F.col("r.number").alias("number"), F.round(column_jaccard(F.col("t.columns"), F.col("r.columns")), 4).alias("jaccard"), (F.col("r.n_rows") >= F.col("t.min_rows")).alias("rows_ok")).where(F.col("jaccard") >= LEAST_JACCARD)
    got = scored.groupBy("paper").applyInPandas(_assign, scored.schema)
    return truth.select("paper", "table_id").join(got, ["paper", "table_id"], "left")


def without_decorations(images: DataFrame, least_area: float) -> DataFrame:
    """Image blocks of at least an area in square points; rules, logos and icons are smaller. The threshold is the caller's."""
    b = F.col("bbox")
    return images.where((b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) >= least_area)
