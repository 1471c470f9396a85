"""Queries of counts, records and files: routing, adoption, packages, front matter, caption lines, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import batch, edits, matching, rescue, scoring
from ..sources import files, markdown
from . import inputs
from .reference_queries import _NEAR, _blocks
from .registry import made, plain, query, table

_CHARS = "length(coalesce(text, ''))"
_REASON = f"case when doc_id % 13 = 0 then 'error:broken' when doc_id % 17 = 0 then 'empty-doc' when {_CHARS} < 300 then 'sparse-text-layer' when doc_id % 3 = 0 then 'no-super-flags-preserved' when doc_id % 5 < 2 then 'no-heading-discrimination' else 'clean-modern-text-layer' end"


@query(f"select case when reason = 'clean-modern-text-layer' then 'layout' else 'ocr' end as route, reason, count(*) as n from (select {_REASON} as reason from documents) group by all")
def routing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents go which way, and why."""
    d = table(spark, sf_dir, "documents")
    n = lambda k: F.col("doc_id") % k
    chars = F.length(F.coalesce("text", F.lit("")))
    r = scoring.routing(F.when(n(13) == 0, "broken"), F.when(n(17) == 0, 0).otherwise(1), chars, F.when(n(3) == 0, 0).otherwise(2), F.when(n(5) < 2, 1).otherwise(6))
    return scoring.routing_summary(d.select(r.alias("routing")))


@query(_NEAR + ", c as (select doc_id, count(*) filter (where what = 'caption') as captions, count(*) filter (where what = 'footnote') as footnotes from n where r = 1 group by doc_id) select doc_id, 6 as parents, coalesce(captions, 0) as captions, coalesce(footnotes, 0) as footnotes from documents left join c using (doc_id)")
def adoption_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescue.adoption_counts(_blocks(spark, sf_dir))


@query("select run, string_agg(name || '=' || version, ',' order by name) as packages from (select user_id as run, event_type as name, max('1.' || cast(event_id % 9 as varchar)) as version from events where event_id % 4 > 0 group by all) group by run")
def package_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packages of every run, without those of unknown version."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("run"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("1."), (F.col("event_id") % 9).cast("string"))).alias("version"))
    return batch.packages(rows).select("run", F.array_join(F.transform(F.map_entries("packages"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("packages"))


@query(
    """select doc_id, '---' || chr(10) || 'doc_id: ' || cast(doc_id as varchar) || chr(10) || coalesce('lang: ' || lang || chr(10), '') || case when doc_id % 2 = 0 then 'note: "a: b' || chr(92) || '"c' || chr(92) || '""' || chr(10) else '' end || '---' || chr(10) as front,
    '{"doc_id":' || cast(doc_id as varchar) || coalesce(',"lang":"' || lang || '"', '') || case when doc_id % 2 = 0 then ',"note":"a: b' || chr(92) || '"c' || chr(92) || '""' else '' end || '}' as meta,
    sha256(coalesce(text, '')) as text_sha256, 'doc_id: ' || cast(doc_id as varchar) || chr(10) || coalesce('lang: ' || lang || chr(10), '') || case when doc_id % 2 = 0 then 'note: "a: b' || chr(92) || '"c' || chr(92) || '""' || chr(10) else '' end as read_back, length(coalesce(text, '')) as body_chars from documents"""
)
def front_matters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter before whole texts, its JSON mirror, the text's hash; and what a reader takes apart again."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    fields = {"doc_id": F.col("doc_id"), "lang": F.col("lang"), "note": F.when(F.col("doc_id") % 2 == 0, 'a: b"c"')}
    front = tx.yaml_block(fields)
    md = F.concat(front, "text")
    return d.select("doc_id", front.alias("front"), tx.record_json(fields).alias("meta"), tx.content_hash(F.col("text")).alias("text_sha256"), markdown.front_matter(md).alias("read_back"), F.length(markdown.body(md)).alias("body_chars"))


_CAPTIONED = "select doc_id, coalesce(text, '') || chr(10) || 'Table II. Values' || chr(10) || case when doc_id % 2 = 0 then '**Figure 3** shows' || chr(10) else '' end || 'Fig. 31 is another' || chr(10) || 'table ii: again' as md from {docs}"


@query(
    f"""select doc_id, kind, id, case when kind = 'table' then n + 1 when doc_id % 2 = 0 and id = '3' then n + 2 when id = '31' then n + 2 + (doc_id + 1) % 2 end as line from
    (select doc_id, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 as n from documents), (values ('table', 'II'), ('figure', '3'), ('figure', '31'), ('figure', 'S1')) w(kind, id)"""
)
def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of a caption below whole texts."""
    md = made(spark, sf_dir, _CAPTIONED)
    each = [F.struct(F.lit(k).alias("kind"), F.lit(i).alias("id")) for k, i in (("table", "II"), ("figure", "3"), ("figure", "31"), ("figure", "S1"))]
    return edits.caption_line(markdown.lines(md), md.select("doc_id", F.explode(F.array(*each)).alias("w")).select("doc_id", "w.*"))


@query("select doc_id, page_idx, idx from " + plain(inputs.BLOCKS) + " where type in ('image', 'chart', 'table') and (x1 - x0) * (y1 - y0) >= 17000")
def undecorated_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and tables without the smaller ones."""
    b = _blocks(spark, sf_dir)
    return matching.without_decorations(b.where(F.col("type").isin(*rescue.PARENTS)), 17_000).select("doc_id", "page_idx", "idx")


@query(
    """select doc_id, path, content, case when doc_id % 3 = 0 then 'no-schema-version' when doc_id % 3 = 1 then 'schema-version 1' end as warning from (
    select doc_id, cast(doc_id as varchar) || '.md' as path, coalesce(text, '') as content from documents
    union all select doc_id, cast(doc_id as varchar) || '.meta.json', '{}' from documents where doc_id % 2 = 0
    union all select doc_id, 'assets/a.png', 'png' from documents)"""
)
def unpacked_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of bundles, with a warning where the schema version is another."""
    d = table(spark, sf_dir, "documents")
    bundle = d.select("doc_id", F.when(F.col("doc_id") % 3 == 1, "1").when(F.col("doc_id") % 3 == 2, "2").alias("version"), F.coalesce("text", F.lit("")).alias("md"), F.when(F.col("doc_id") % 2 == 0, "{}").alias("meta"), F.array(F.struct(F.lit("a.png").alias("name"), F.lit("png").cast("binary").alias("content"))).alias("assets"))
    return files.unpacked(bundle, "2").withColumn("content", F.col("content").cast("string"))
