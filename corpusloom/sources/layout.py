"""Layout JSON -> blocks, page footnotes and page sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.captions import repair_label
from ..functions.geometry import box
from ..functions.text import blank_to_null, join_lines

_LINE = "struct<spans:array<struct<type:string,content:string,html:string,image_path:string>>>"
_CHILD = f"struct<type:string,bbox:array<double>,lines:array<{_LINE}>>"
_BLOCK = f"struct<type:string,index:int,bbox:array<double>,level:int,text_level:int,lines:array<{_LINE}>,blocks:array<{_CHILD}>>"
SCHEMA = f"_backend string, _version_name string, pdf_info array<struct<page_idx:int,page_size:array<double>,para_blocks:array<{_BLOCK}>,discarded_blocks:array<{_BLOCK}>>>"

TEXT = ("text", "title", "abstract", "ref_text")
FIGURES = ("image", "chart")


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*_middle.json`` file below a folder as ``(path, json)``."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_middle.json").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("json"))


def parsed(df: DataFrame, json_col: str = "json", id_col: str = "doc_id") -> DataFrame:
    """One row a page; a text that isn't JSON gives none."""
    doc = F.from_json(json_col, SCHEMA)
    return df.select(F.col(id_col).alias("doc_id"), doc.alias("d")).select("doc_id", F.explode("d.pdf_info").alias("page"))


def _span(block: Column, name: str) -> Column:
    return F.try_element_at(F.try_element_at(block["lines"], F.lit(1))["spans"], F.lit(1))[name]


def _merged(children: Column, kinds: tuple[str, ...]) -> Column:
    """Caption or footnote fragments joined in reading order."""
    mine = F.filter(F.coalesce(children, F.array().cast(f"array<{_CHILD}>")), lambda c: c["type"].isin(*kinds))
    placed = F.transform(mine, lambda c: F.struct(F.coalesce(F.try_element_at(c["bbox"], F.lit(2)), F.lit(0.0)).alias("y"), F.coalesce(F.try_element_at(c["bbox"], F.lit(1)), F.lit(0.0)).alias("x"), join_lines(c["lines"]).alias("t")))
    return blank_to_null(F.array_join(F.transform(F.array_sort(F.filter(placed, lambda p: p["t"] != "")), lambda p: p["t"]), " "))


def _child(children: Column, kinds: tuple[str, ...], name: str) -> Column:
    bodies = F.filter(F.coalesce(children, F.array().cast(f"array<{_CHILD}>")), lambda c: c["type"].isin(*kinds))
    return _span(F.try_element_at(bodies, F.lit(-1)), name)


def blocks(pages: DataFrame) -> DataFrame:
    """Blocks in the form that all layout operators take; unknown types stay if they have lines."""
    b = F.col("b")
    kind = b["type"]
    rows = pages.select("doc_id", F.col("page.page_idx").alias("page_idx"), F.explode("page.para_blocks").alias("b"))
    figure, table, formula = kind.isin(*FIGURES), kind == "table", kind == "interline_equation"
    caption = F.when(figure, _merged(b["blocks"], ("image_caption", "chart_caption"))).otherwise(_merged(b["blocks"], ("table_caption",)))
    text = F.when(figure | table, repair_label(caption)).when(~formula, join_lines(b["lines"]))
    image = F.when(figure, _child(b["blocks"], ("image_body", "chart_body"), "image_path")).when(table, _child(b["blocks"], ("table_body",), "image_path")).when(formula, _span(b, "image_path"))
    return (
        rows.where(kind.isin(*TEXT, *FIGURES, "table", "interline_equation") | (F.coalesce(F.size(b["lines"]), F.lit(0)) > 0))
        .select(
            "doc_id",
            "page_idx",
            F.coalesce(b["index"], F.lit(0)).alias("idx"),
            F.coalesce(kind, F.lit("unknown")).alias("type"),
            box(b["bbox"]).alias("bbox"),
            text.alias("text"),
            image.alias("image_path"),
            F.when(table, _child(b["blocks"], ("table_body",), "html")).alias("html"),
            F.when(formula, _span(b, "content")).alias("latex"),
            F.when(kind.isin(*TEXT), F.coalesce(F.nullif(b["level"], F.lit(0)), b["text_level"])).alias("text_level"),
            F.when(table, _merged(b["blocks"], ("table_footnote",))).alias("footnote"),
        )
    )


def footnotes(pages: DataFrame) -> DataFrame:
    """Discarded blocks that are page footnotes with text."""
    b = F.col("b")
    rows = pages.select("doc_id", F.col("page.page_idx").alias("page_idx"), F.explode("page.discarded_blocks").alias("b"))
    return rows.where(b["type"] == "page_footnote").select("doc_id", "page_idx", F.coalesce(F.try_element_at(b["bbox"], F.lit(2)), F.lit(0.0)).alias("y0"), join_lines(b["lines"]).alias("text")).where("text <> ''")


def page_sizes(pages: DataFrame) -> DataFrame:
    size = F.col("page.page_size")
    return pages.where(F.size(size) >= 2).select("doc_id", F.col("page.page_idx").alias("page_idx"), F.element_at(size, 1).alias("width"), F.element_at(size, 2).alias("height"))
