"""Markdown documents: front matter, page selections, line views, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Every ``.md`` file below a folder as ``(path, md)``."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("md"))


def front_matter(md: Column) -> Column:
    """The block between ``---`` lines at the very start, null without one."""
    end = F.locate("\n---\n", md, 5)
    return F.when(md.startswith("---\n") & (end > 0), F.substring(md, F.lit(5), end - 4))


def body(md: Column) -> Column:
    """The text without its front matter."""
    end = F.locate("\n---\n", md, 5)
    return F.when(md.startswith("---\n") & (end > 0), F.substring(md, end + 5, F.length(md))).otherwise(md)


def lines(df: DataFrame, text: str = "md", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, 0-based line number and text of each line."""
    return df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def selected_pages(selection: Column, n_pages: Column) -> Column:
    """``1,3-5,8`` as sorted 0-based pages; null if a part is malformed or out of range."""
    parts = F.transform(F.split(selection, ","), lambda x: F.trim(x))
    low = lambda p: F.regexp_extract(p, r"^(\d+)(?:-(\d+))?$", 1).try_cast("int")
    high = lambda p: F.coalesce(F.regexp_extract(p, r"^(\d+)-(\d+)$", 2).try_cast("int"), low(p))
    good = F.forall(parts, lambda p: F.coalesce((low(p) >= 1) & (high(p) >= low(p)) & (high(p) <= n_pages), F.lit(False)))
    return F.when(good, F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p) - 1, high(p) - 1))))))


def subset_suffix(pages: Column) -> Column:
    """File-name suffix of a page selection: ``_p5``, ``_p3-7``, ``_p1+3``."""
    first, last = F.array_min(pages) + 1, F.array_max(pages) + 1
    joined = F.array_join(F.transform(pages, lambda p: (p + 1).cast("string")), "+")
    return F.when(F.size(pages) == 1, F.concat(F.lit("_p"), first.cast("string"))).when(last - first + 1 == F.size(pages), F.concat(F.lit("_p"), first.cast("string"), F.lit("-"), last.cast("string"))).otherwise(F.concat(F.lit("_p"), joined))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).csv(path)


def append_manifest(df: DataFrame, path: str) -> None:
    """One JSON object a row; nulls are left out."""
    df.write.mode("append").json(path)


def accepted_pdf(content_type: Column, url: Column, size: Column) -> Column:
    """Whether a download is a usable PDF: its type says so or its address does, and it is over 1024 bytes."""
    return (F.lower(F.coalesce(content_type, F.lit(""))).contains("pdf") | F.lower(url).endswith(".pdf")) & (size > 1024)
