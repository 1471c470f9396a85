"""Blocks -> markdown, numbering, trimming of a following article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.captions import figure_id
from ..functions.text import alt_text, heading_prefix, strip_chart_details

COUNTED = ("image", "chart", "table")


def numbered(blocks: DataFrame) -> DataFrame:
    """``number``: running number of figures, charts and tables, each by its own; adopted blocks don't count."""
    order = Window.partitionBy("doc_id", "type").orderBy("page_idx", "idx")
    return blocks.withColumn("number", F.when(F.col("type").isin(*COUNTED), F.row_number().over(order)))


def block_markdown(folder: str = "assets", prefix: str = "", strip_charts: bool = False) -> Column:
    """Markdown of a block row; tables come from a column ``table_md``, panels from ``panel_paths`` and ``panel_letters`` if not null."""
    text = F.trim("text")
    at = lambda path: F.concat(F.lit(f"]({folder}/{prefix}"), path, F.lit(")"))
    formula = F.when(F.col("latex").isNotNull() & (F.col("latex") != ""), F.concat(F.lit("$$\n"), F.trim("latex"), F.lit("\n$$")))
    picture = F.when(F.col("image_path").isNotNull(), F.concat(F.lit("![equation"), at(F.col("image_path"))))
    caption = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.concat(F.lit("Figure "), F.col("number").cast("string")))
    shown = F.coalesce("figure_number", "number").cast("string")
    panels = F.array_join(F.transform(F.arrays_zip("panel_letters", "panel_paths"), lambda p: F.concat(F.lit("![Figure "), shown, F.lit(" panel "), p["panel_letters"], at(p["panel_paths"]))), "\n\n")
    one = F.when(F.col("image_path").isNotNull(), F.concat(F.lit("!["), alt_text(caption), at(F.col("image_path")), F.lit("\n\n"))).otherwise("")
    figure = F.concat(F.when(F.size("panel_paths") > 1, F.concat(panels, F.lit("\n\n"))).otherwise(one), F.lit("*"), caption, F.lit("*"))
    plain = strip_chart_details(text) if strip_charts else text
    kind = F.col("type")
    return (
        F.when(kind == "title", F.concat(heading_prefix(F.col("text_level")), text))
        .when(kind == "abstract", F.concat(F.lit("**Abstract.** "), text))
        .when(kind == "interline_equation", F.concat_ws("\n\n", formula, picture))
        .when(kind.isin("image", "chart"), figure)
        .when(kind == "table", F.col("table_md"))
        .otherwise(plain)
    )


def assembled(blocks: DataFrame, folder: str = "assets", prefix: str = "", strip_charts: bool = False) -> DataFrame:
    """``doc_id, md``: all blocks but adopted ones in reading order, parted by blank lines."""
    rows = numbered(blocks.where(~F.col("type").startswith("_adopted")))
    missing = {"latex": "string", "table_md": "string", "figure_number": "int", "panel_paths": "array<string>", "panel_letters": "array<string>", "text_level": "int"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in rows.columns})
    md = rows.select("doc_id", "page_idx", "idx", block_markdown(folder, prefix, strip_charts).alias("md")).where("md <> ''")
    order = F.struct("page_idx", "idx", "md")
    return md.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["md"]), "\n\n").alias("md"))


def figure_records(blocks: DataFrame, prefix: str = "") -> DataFrame:
    """Score rows of figures with an image: file, caption length, score and figure id (that of the caption, else the running number)."""
    rows = numbered(blocks).where(F.col("type").isin("image", "chart") & F.col("image_path").isNotNull())
    full = F.coalesce(F.col("text"), F.lit("")) != ""
    return rows.select("doc_id", F.concat(F.lit(prefix), "image_path").alias("filename"), full.alias("captioned"), F.length(F.coalesce("text", F.lit(""))).alias("caption_length"), F.when(full, 1.0).otherwise(0.6).alias("score"), F.coalesce(figure_id(F.col("text")), F.col("number").cast("string")).alias("matched_figure"))


def boundary(verdicts: DataFrame) -> DataFrame:
    """First page of a following article from page verdicts ``doc_id, page_idx, same, title``: pages after it all differ, the last one included; title of that page's verdict."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("page_idx"))
    tail = verdicts.withColumn("differs", F.min((~F.coalesce("same", F.lit(True))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return tail.where("differs = 1 and page_idx > 0").groupBy("doc_id").agg(F.min("page_idx").alias("page"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("page_idx"))).alias("title"))


def title_block(blocks: DataFrame, cuts: DataFrame) -> DataFrame:
    """``doc_id, page_idx, idx``: the last block, from the boundary page on, that holds the longest run of the title's words (three at least)."""
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"\W+", " "), " "), lambda w: w != "")
    w = words(F.col("title"))
    sizes = F.sequence(F.size(w), F.lit(3), F.lit(-1))
    phrases = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda s: F.struct(n.alias("n"), (-s).alias("s"), F.concat(F.lit(" "), F.array_join(F.slice(w, s + 1, n), " "), F.lit(" ")).alias("phrase")))))
    asked = cuts.where(F.size(w) >= 3).select("doc_id", "page", F.explode(phrases).alias("p")).select("doc_id", "page", "p.*")
    own = blocks.select("doc_id", "page_idx", "idx", F.concat(F.lit(" "), F.array_join(words(F.coalesce("text", F.lit(""))), " "), F.lit(" ")).alias("norm"))
    hits = asked.join(own, "doc_id").where((F.col("page_idx") >= F.col("page")) & F.col("norm").contains(F.col("phrase")))
    return hits.groupBy("doc_id").agg(F.max(F.struct("n", "s", "page_idx", "idx")).alias("x")).select("doc_id", "x.page_idx", "x.idx")


def trimmed(blocks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Blocks before the title of a following article; without its title in the blocks nothing is cut."""
    at = title_block(blocks, boundary(verdicts)).select("doc_id", F.struct("page_idx", "idx").alias("cut"))
    return blocks.join(at, "doc_id", "left").where(F.col("cut").isNull() | (F.struct("page_idx", "idx") < F.col("cut"))).drop("cut")
