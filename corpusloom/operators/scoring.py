"""Scores, grades and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Makers of scanned files' text layers.
OCR_MAKERS = r"(?i)ABBYY|FineReader|OmniPage|ScanSoft|Adobe\s*Capture|AdobeOCR|Capture\s+Plug-in|Iris\s*OCR|Readiris|Tesseract|\bOCR\b"


def table_score(located: Column, redone: Column, clean: Column) -> Column:
    """Rubric of the table hook: how a table was found, rewritten, and how it looks."""
    return F.when(located & redone, F.when(clean, 1.0).otherwise(0.6)).when(located, F.when(clean, 0.8).otherwise(0.4)).when(redone, F.when(clean, 0.85).otherwise(0.55)).otherwise(F.when(clean, 0.7).otherwise(0.3))


def figure_score(on_disk: Column, matched: Column, dropped: Column, words: Column, model: Column) -> Column:
    return F.when(dropped, 0.8).when(~on_disk, 0.3).when(matched, 1.0).when(~model, 0.8).when(words >= 5, 1.0).otherwise(0.7)


def block_figure_score(caption: Column) -> Column:
    return F.when(F.coalesce(caption, F.lit("")) != "", 1.0).otherwise(0.6)


def page_score(density: Column, is_sparse: Column, is_rescued: Column, reference: float = 0.01) -> Column:
    """Diagnostic only: no part of the overall score."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), density / reference))
    return F.when(is_sparse & is_rescued, F.greatest(base, F.lit(0.7))).when(is_sparse, F.greatest(base, F.lit(0.3))).otherwise(base)


def overall(tables: Column, figures: Column) -> Column:
    """Mean table score at 0.6 and mean figure score at 0.4; one alone counts fully, none is 0."""
    return F.when(tables.isNotNull() & figures.isNotNull(), 0.6 * tables + 0.4 * figures).otherwise(F.coalesce(tables, figures, F.lit(0.0)))


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C").when(score >= 0.6, "D").otherwise("F")


def document_scores(tables: DataFrame, figures: DataFrame, docs: DataFrame) -> DataFrame:
    """Overall score, grade and run-summary counts of each document of ``docs``."""
    t = tables.groupBy("doc_id").agg(F.avg("score").alias("t"), F.count("*").alias("n_tables"), F.count_if(F.col("score") >= 0.9).alias("clean"), F.count_if("redone").alias("redone"))
    f = figures.groupBy("doc_id").agg(F.avg("score").alias("f"), F.count("*").alias("n_figures"), F.count_if("captioned").alias("captioned"))
    zero = {c: 0 for c in ("n_tables", "clean", "redone", "n_figures", "captioned")}
    both = docs.select("doc_id").join(t, "doc_id", "left").join(f, "doc_id", "left").fillna(zero)
    score = F.round(overall(F.col("t"), F.col("f")), 4)
    return both.select("doc_id", score.alias("overall"), grade(score).alias("grade"), "n_tables", "clean", "redone", (F.col("n_tables") - F.col("clean") - F.col("redone")).alias("fallback"), "n_figures", "captioned")


def text_layer(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Text-layer figures of each file from its first pages' spans ``doc_id, page_idx, text, size, flags``; ``pages``: ``doc_id, n_pages, probed``."""
    super_, styled = F.col("flags").bitwiseAND(1) != 0, F.col("flags").bitwiseAND(19) != 0
    by = spans.groupBy("doc_id").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.count("*").alias("n"), F.count_distinct(F.when(F.col("size") > 0, F.bround(F.col("size") * 2) / 2)).alias("sizes"), F.count_if(super_).alias("supers"), F.count_if(styled).alias("styled"), F.count_if(F.col("text").rlike("[\\uFFFD□■]")).alias("unknown"))
    share = lambda c: F.coalesce(F.try_divide(c, "n"), F.lit(0.0))
    return pages.join(by, "doc_id", "left").select("doc_id", F.col("n_pages").alias("pages"), F.coalesce(F.try_divide("chars", "probed"), F.lit(0.0)).alias("chars_per_page"), F.coalesce("sizes", F.lit(0)).alias("distinct_font_sizes"), F.coalesce("supers", F.lit(0)).alias("super_flag_count"), share("styled").alias("style_flag_pct"), share("unknown").alias("unknown_char_pct"))


def routing(error: Column, pages: Column, chars_per_page: Column, supers: Column, sizes: Column, chars_min: float = 300, sizes_min: int = 4) -> Column:
    """``struct<route, reason>`` of a file by its text layer."""
    rules = [(error.isNotNull(), F.concat(F.lit("error:"), error)), (pages == 0, F.lit("empty-doc")), (chars_per_page < chars_min, F.lit("sparse-text-layer")), (supers == 0, F.lit("no-super-flags-preserved")), (sizes < sizes_min, F.lit("no-heading-discrimination"))]
    reason = None
    for hit, name in rules:
        reason = F.when(hit, name) if reason is None else reason.when(hit, name)
    why = reason.otherwise("clean-modern-text-layer")
    return F.struct(F.when(why == "clean-modern-text-layer", "layout").otherwise("ocr").alias("route"), why.alias("reason"))


def scan_verdict(producer: Column, creator: Column, cover: Column, fonts: Column, bold: Column) -> Column:
    """Why a file is a scan, null if it isn't."""
    made = F.coalesce(producer, F.lit("")).rlike(OCR_MAKERS) | F.coalesce(creator, F.lit("")).rlike(OCR_MAKERS)
    signs = (cover > 0.4).cast("int") + (fonts <= 4).cast("int") + (bold > 0.25).cast("int")
    return F.when(made, "maker").when((cover > 0.6) & (fonts <= 3), "cover-and-fonts").when(signs >= 2, "two-signs")


def composed_routing(route: Column, scan: Column) -> Column:
    """``struct<engine, force_ocr>``: OCR if either probe says so, forced for scans."""
    ocr = (route == "ocr") | scan.isNotNull()
    return F.struct(F.when(ocr, "ocr").otherwise("layout").alias("engine"), (ocr & scan.isNotNull()).alias("force_ocr"))


def routing_summary(routed: DataFrame) -> DataFrame:
    """``route, reason, n`` over files with a ``routing`` struct."""
    return routed.groupBy("routing.route", "routing.reason").agg(F.count("*").alias("n"))
