"""Further queries: captions by place, article trim, bundles, benchmarks, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import captions as cap
from ..functions import geometry as geo
from ..functions import udfs
from ..operators import edits, emit, links, matching, rescue, rewrites, scoring
from ..sources import bundles
from .registry import query, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id")


def _each(df: DataFrame, **columns: list) -> DataFrame:
    """Every document with each of some rows, given as lists of values or columns."""
    names = list(columns)
    rows = [F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, row, strict=True))) for row in zip(*columns.values(), strict=True)]
    return df.select("doc_id", F.explode(F.array(*rows)).alias("r")).select("doc_id", "r.*")


@query("select doc_id, 20 as line_no, case when doc_id % 3 = 0 then 'b.jpg' when doc_id % 3 = 1 then 'c.jpg' end as href from documents where doc_id % 3 < 2")
def asset_near_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image line nearest to a caption, one before it first."""
    d = _docs(spark, sf_dir)
    images = _each(d.where("doc_id % 3 = 0"), line_no=[11, 15, 21], href=["a.jpg", "b.jpg", "c.jpg"]).unionByName(_each(d.where("doc_id % 3 = 1"), line_no=[24], href=["c.jpg"])).unionByName(_each(d.where("doc_id % 3 = 2"), line_no=[40], href=["far.jpg"]))
    return matching.asset_near_caption(_each(d, line_no=[20]), images)


@query("select doc_id, 1000 as start, case doc_id % 3 when 0 then 900 when 1 then 1100 end as off, case doc_id % 3 when 0 then 'II' when 1 then 'III' end as table_id from documents where doc_id % 3 < 2")
def captions_for_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest caption above a table, else the first below, within a window."""
    d = _docs(spark, sf_dir)
    c = _each(d.where("doc_id % 3 = 0"), off=[300, 900, 1100], table_id=["I", "II", "III"]).unionByName(_each(d.where("doc_id % 3 = 1"), off=[100, 1100, 1150], table_id=["I", "III", "IV"])).unionByName(_each(d.where("doc_id % 3 = 2"), off=[10], table_id=["I"]))
    return matching.caption_for_table(_each(d, start=[1000], end=[1050]), c)


@query("select doc_id, '1' as label, case when doc_id % 2 = 0 then 5 else 2 end as page from documents")
def caption_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caption's page: where it begins a line, else where it is first named."""
    d = _docs(spark, sf_dir)
    return matching.caption_page(_each(d.where("doc_id % 2 = 0"), label=["1", "1"], page=[2, 5], leading=[False, True]).unionByName(_each(d.where("doc_id % 2 = 1"), label=["1", "1"], page=[2, 5], leading=[False, False])))


@query("select doc_id, filename, figure, verdict from documents, (values ('a', '1', 'same-page'), ('b', '2', 'too-far'), ('c', '3', 'other-caption'), ('d', '4', 'neighbour'), ('e', '5', 'unknown')) v(filename, figure, verdict)")
def page_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure matches held against the page of their caption."""
    d = _docs(spark, sf_dir)
    m = _each(d, filename=list("abcde"), image_page=[1, 1, 3, 5, 1], figure=list("12345"), caption_page=[F.lit(1), F.lit(4), F.lit(4), F.lit(6), F.lit(None).cast("int")])
    return rescue.page_local(m, _each(d, page=[1, 3], figure=["1", "9"]))


@query("select doc_id, 0 as page_idx, 1 as table_idx, case doc_id % 3 when 0 then 130.0 when 1 then 100.0 else 120.0 end::double as y1 from documents")
def table_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with the footnotes below them, up to the first other text."""
    d = _docs(spark, sf_dir)
    bbox = lambda y0, y1: F.struct(F.lit(10.0).alias("x0"), F.lit(float(y0)).alias("y0"), F.lit(90.0).alias("x1"), F.lit(float(y1)).alias("y1"))
    tables = _each(d, page_idx=[0], idx=[1], bbox=[bbox(50, 100)], page_height=[800.0])
    texts = _each(d.where("doc_id % 3 = 0"), page_idx=[0, 0, 0], idx=[2, 3, 4], bbox=[bbox(102, 120), bbox(121, 130), bbox(140, 700)], text=["* one", "a) two", "* far too tall"])
    texts = texts.unionByName(_each(d.where("doc_id % 3 = 1"), page_idx=[0], idx=[2], bbox=[bbox(102, 120)], text=["Body text"]))
    texts = texts.unionByName(_each(d.where("doc_id % 3 = 2"), page_idx=[0, 0, 0], idx=[2, 3, 4], bbox=[bbox(102, 120), bbox(121, 130), bbox(131, 140)], text=["* one", "Body", "* after"]))
    return rescue.footnote_extension(tables, texts)


@query("select doc_id, case when doc_id % 2 = 0 then case when doc_id % 3 = 0 then 'above' else 'below' end else 'column' end as side from documents")
def crop_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On which side of its caption a figure is."""
    d = _docs(spark, sf_dir)
    b = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.when(F.col("doc_id") % 2 == 0, 500.0).otherwise(200.0).alias("x1"), F.lit(9.0).alias("y1"))
    return d.select("doc_id", geo.crop_side(b, F.lit(612.0), F.when(F.col("doc_id") % 3 == 0, 1.0).otherwise(9.0), F.lit(5.0)).alias("side"))


@query("select doc_id, page_idx, idx from documents, (values (0, 0), (0, 1), (1, 0), (2, 0), (2, 1), (2, 2), (3, 0)) b(page_idx, idx) where doc_id % 3 > 0 or (page_idx, idx) < (2, 1)")
def trimmed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks before a following article's title; without the title in the text nothing is cut."""
    d = _docs(spark, sf_dir)
    blocks = _each(d, page_idx=[0, 0, 1, 2, 2, 2, 3], idx=[0, 1, 0, 0, 1, 2, 0], text=["Own title", "see the origin of the moon", "body", "tail", "The Origin of the MOON!", "new text", "more"])
    verdicts = _each(d.where("doc_id % 3 < 2"), page_idx=[1, 2, 3], same=[True, False, False], title=[F.lit(None).cast("string"), F.when(F.col("doc_id") % 3 == 0, "Origin of the Moon").otherwise("A title nobody printed"), F.lit(None).cast("string")])
    return emit.trimmed(blocks, verdicts).select("doc_id", "page_idx", "idx")


@query("select doc_id, case when doc_id % 3 > 0 then 'md' end as md, case when doc_id % 3 = 1 then 'disk' when doc_id % 3 = 2 and doc_id % 2 = 0 then null else 'old' end as meta, case when doc_id % 3 = 2 and doc_id % 2 = 0 then null else 'p.pdf' end as source_pdf, case when doc_id % 3 = 0 then 'markdown-missing-on-disk' end as error from documents")
def repacked_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles renewed from disk: markdown must be there, metadata may stay."""
    d = _docs(spark, sf_dir)
    t = F.lit("2020-01-01")
    bundle = d.where("not (doc_id % 3 = 2 and doc_id % 2 = 0)").select("doc_id", F.lit("old").alias("meta"), F.lit("p.pdf").alias("source_pdf"), F.lit(0.9).alias("overall"), F.lit("A").alias("grade"), t.alias("created_at"), F.lit(None).cast("string").alias("original_created_at"))
    disk = d.where("doc_id % 3 > 0").select("doc_id", F.lit("md").alias("md"), F.when(F.col("doc_id") % 3 == 1, "disk").alias("meta"))
    return bundles.repacked(bundle, disk, F.lit("2026-01-01")).select("doc_id", "md", "meta", "source_pdf", "error")


@query("select 'p' || cast(doc_id as varchar) as paper, table_id, cast(number as integer) as number, jaccard, rows_ok from documents, (values ('I', 1, 1.0, true), ('II', 2, 0.5, false), ('III', null, null, null)) v(table_id, number, jaccard, rows_ok)")
def table_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth tables against extracted ones by column names, none used twice."""
    d = _docs(spark, sf_dir)
    paper = F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("paper")
    cols = lambda *names: F.array(*(F.lit(n) for n in names))
    truth = _each(d, table_id=["I", "II", "III"], page=[1, 1, 2], columns=[cols("A b", "c"), cols("A B", "d", "e"), cols("z")], min_rows=[2, 5, 1]).select(paper, "table_id", "page", "columns", "min_rows")
    run = _each(d, number=[1, 2], page=[1, 1], columns=[cols("a-b", "C"), cols("ab", "d", "x")], n_rows=[3, 3]).select(paper, "number", "page", "columns", "n_rows")
    return matching.table_benchmark(truth, run)


@query("select doc_id, cast(k as varchar) as figure, 10 * k as line_no, 'i' || cast(k as varchar) || '.jpg' as path from documents, (values (1), (2)) v(k) where doc_id % 2 = 0")
def inferred_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left-over captions and images one to one, only where there are as many of both."""
    d = _docs(spark, sf_dir)
    images = _each(d, page_idx=[0, 1], idx=[5, 0], path=["i1.jpg", "i2.jpg"]).unionByName(_each(d.where("doc_id % 2 = 1"), page_idx=[2], idx=[0], path=["i3.jpg"]))
    return matching.inferred_pairs(_each(d, line_no=[10, 20], figure=["1", "2"]), images).select("doc_id", "figure", "line_no", "path")


@query("select doc_id, 'one' || chr(10) || 'new a' || chr(10) || 'new b' || chr(10) || 'two' || chr(10) || 'three' || chr(10) || 'end ' || cast(doc_id as varchar) as md from documents")
def spliced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts placed by line keys; they can't move one another."""
    d = _docs(spark, sf_dir)
    lines = _each(d, line_no=[0, 1, 2], line=["one", "two", "three"])
    return rewrites.spliced(lines, _each(d, after_line=[2, 0, 0], nth=[1, 1, 2], text=[F.concat(F.lit("end "), F.col("doc_id").cast("string")), F.lit("new a"), F.lit("new b")]))


@query("select doc_id, 4 as line_no, 'II' as table_id from documents where doc_id % 2 = 0")
def orphan_table_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table captions that nothing follows."""
    d = _docs(spark, sf_dir)
    rule = F.when(F.col("doc_id") % 2 == 1, "![Table II (page 2)](x.jpg)").otherwise("text")
    lines = _each(d, line_no=[0, 1, 2, 4, 5, 8, 9], line=[F.lit("Table I. First one"), F.lit("| a | b |"), F.lit("| --- | --- |"), F.lit("**Table II.** Second"), rule, F.lit("Table 3: third"), F.lit("[Table 3 — separate markdown](t.md)")])
    return rewrites.orphan_table_captions(lines)


@query("select doc_id, line_no, line from documents, (values (0, 'text'), (2, '![b](assets/keep.jpg)')) v(line_no, line)")
def stripped_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image links of given files go, with the anchor before them."""
    d = _docs(spark, sf_dir)
    lines = _each(d, line_no=[0, 1, 2], line=["text", '<span id="page-1-0"></span>![a](x/gone.jpg)', "![b](assets/keep.jpg)"])
    return rewrites.without_images(lines, _each(d, name=["gone.jpg"]))


@query("select doc_id, '# T' || chr(10) || '## References' || chr(10) || 'right one' || chr(10) || '## End' as md, true as swapped from documents where doc_id % 2 = 0 union all select doc_id, '# T' || chr(10) || '## References' || chr(10) || 'left one' || chr(10) || '## End', false from documents where doc_id % 2 = 1")
def swapped_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references section of another source, if nothing of another article follows it."""
    d = _docs(spark, sf_dir)
    left = d.select("doc_id", F.lit("# T\n## References\nleft one\n## End").alias("md"))
    right = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "x\n## References\nright one").otherwise("x\n## References\nright one\n# Another article").alias("md"))
    return rewrites.swapped_sections(left, right)


@query("select doc_id, v.row as r, v.cell, v.text, v.span from documents, (values (0, 0, 'a', 2), (1, 0, 'b', 1), (1, 1, 'c', 1)) v(row, cell, text, span)")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function over HTML, laterally joined."""
    udfs.register(spark)
    d = _docs(spark, sf_dir).withColumn("html", F.lit("<table><tr><td colspan=2>a</td></tr><tr><td>b</td><td>c</td></tr></table>"))
    return spark.sql("select doc_id, c.row as r, c.cell, c.text, c.span from {d}, lateral table_cells(html) c", d=d)


@query("select doc_id, 'ok' as fetch_status, 'T' || cast(doc_id as varchar) as title, 'd e' as description, 'cc-by-4.0' as license, cast(1 as integer) as n_files from documents where doc_id % 4 = 0 union all select doc_id, case doc_id % 4 when 1 then 'not_found' when 2 then 'parse_error' else 'not_implemented' end, null, null, null, null from documents where doc_id % 4 > 0")
def deposit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-fetched repository responses as summaries with a fetch status."""
    d, s = _docs(spark, sf_dir), F.col("doc_id").cast("string")
    m = F.col("doc_id") % 4
    body = F.when(m == 2, "{oops").otherwise(F.concat(F.lit('{"metadata":{"title":"T'), s, F.lit('","description":"<p>d</p> e","license":{"id":"cc-by-4.0"}},"files":[{"key":"a.csv","size":3}]}')))
    r = d.select(F.when(m == 3, "icpsr").otherwise("zenodo").alias("repository"), s.alias("key"), F.when(m == 1, 404).otherwise(200).alias("status"), body.alias("body"))
    out = links.parsed_summary(r)
    return out.select(F.col("key").cast("bigint").alias("doc_id"), "fetch_status", "title", "description", "license", F.when(F.col("files").isNotNull(), F.size("files")).alias("n_files"))


@query("select doc_id, kind, id, note, by_whom from (select doc_id, 'table' as kind, '1' as id, 'p' as note, 'me' as by_whom from documents where doc_id % 2 = 0 union all select doc_id, 'table', '9', 'e', null from documents)")
def promoted_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed recoveries move from pending to edits."""
    d = _docs(spark, sf_dir)
    pending, own = _each(d, kind=["table"], id=["1"], note=["p"]), _each(d, kind=["table"], id=["9"], note=["e"])
    return edits.promoted(pending, own, _each(d.where("doc_id % 2 = 0"), kind=["table"], id=["1"], by_whom=["me"]))[1]


@query("select doc_id, case when doc_id % 4 = 0 then 1.0 when doc_id % 4 = 1 then 0.4 when doc_id % 4 = 2 then 0.85 else 0.3 end::double as table_score, case when doc_id % 5 = 0 then 0.8 when doc_id % 5 = 1 then 0.3 when doc_id % 5 = 2 then 1.0 else 0.7 end::double as figure_score, case when doc_id % 3 = 0 then 0.7 when doc_id % 3 = 1 then 0.3 else 1.0 end::double as page_score from documents")
def rubric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table, figure and page rubrics."""
    n = lambda k: F.col("doc_id") % k
    t = scoring.table_score(n(4) < 2, (n(4) == 0) | (n(4) == 2), (n(4) == 0) | (n(4) == 2))
    f = scoring.figure_score(n(5) != 1, n(5) == 2, n(5) == 0, F.lit(3), F.lit(True))
    p = scoring.page_score(F.when(n(3) == 2, 0.05).otherwise(0.0), n(3) < 2, n(3) == 0)
    return _docs(spark, sf_dir).select("doc_id", t.alias("table_score"), f.alias("figure_score"), p.alias("page_score"))


@query("select doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z]{9,}'), lambda x: length(x) > 0)))[1:3], ',') as words from documents where length(text) > 0")
def long_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set functions on real texts: the first three distinct long words of each."""
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return d.select("doc_id", F.array_join(F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z]{9,})"), 1))), 1, 3), ",").alias("words"))


@query("select doc_id, 'c,a,b' as letters from documents")
def panel_lettering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(cap.panel_letters(F.lit("c"), F.lit(3)), ",").alias("letters"))
