"""Files that other programs read: PDFs, spans of text layers, document files with metadata, lookup caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = "doc_id bigint, page_idx int, text string, size double, flags int"


def discovered(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, stem, n_bytes`` of the matching files below a folder, in order of path; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), F.col("length").alias("n_bytes")).orderBy("path")


def layout_of(files: DataFrame, stem: Column) -> DataFrame:
    """Of the layout files of each ``stem``, the one in an ``auto`` folder, else the first by path: ``stem, path``."""
    own = files.select(stem.alias("stem"), "path")
    return own.groupBy("stem").agg(F.min_by("path", F.struct(~F.col("path").rlike("/auto/[^/]*$"), F.col("path"))).alias("path"))


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Text-layer spans that an extractor wrote as JSON lines; lines that don't parse are dropped."""
    return spark.read.schema(SPANS).option("mode", "DROPMALFORMED").json(path)


def write_documents(df: DataFrame, folder: str) -> None:
    """``doc_id, md, meta`` as a Parquet table: a markdown file and its structured mirror in one row."""
    df.select("doc_id", "md", "meta").write.mode("overwrite").parquet(folder)


def unpacked(bundle: DataFrame, known_version: str) -> DataFrame:
    """``doc_id, path, content, warning`` for each file of a bundle ``doc_id, version, md, meta, assets array<struct<name, content>>``."""
    warning = F.when(F.col("version").isNull(), "no-schema-version").when(F.col("version") != known_version, F.concat(F.lit("schema-version "), F.col("version")))
    file = lambda name, content: F.when(content.isNotNull(), F.struct(name.alias("path"), content.cast("binary").alias("content")))
    stem = F.col("doc_id").cast("string")
    own = F.array_compact(F.array(file(F.concat(stem, F.lit(".md")), F.col("md")), file(F.concat(stem, F.lit(".meta.json")), F.col("meta"))))
    assets = F.transform(F.coalesce("assets", F.array().cast("array<struct<name:string,content:binary>>")), lambda a: F.struct(F.concat(F.lit("assets/"), a["name"]).alias("path"), a["content"].alias("content")))
    return bundle.select("doc_id", F.explode(F.concat(own, assets)).alias("f"), warning.alias("warning")).select("doc_id", "f.path", "f.content", "warning")


def load_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A lookup cache of JSON lines; without a file, or for lines that don't parse, nothing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def save_cache(df: DataFrame, path: str) -> None:
    """Write a cache beside its place and move it there once it is whole."""
    spark = df.sparkSession
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    df.write.mode("overwrite").json(f"{path}.new")
    new, own = path_of(f"{path}.new"), path_of(path)
    files = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(own, True)
    if not files.rename(new, own):
        raise OSError(f"could not move {path}.new")
