"""Queries over the document operators. SQL forms are written for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import captions as cap
from ..functions import geometry as geo
from ..functions import identity, text
from ..functions.rules import JOURNALS
from ..operators import audit, batch, edits, emit, links, matching, metadata, references, rescue, rewrites, scoring, tables
from ..sources import layout, markdown
from . import inputs
from .registry import made, plain, query, table

_BODY = "case when starts_with(md, '---' || chr(10)) and strpos(substr(md, 5), chr(10) || '---' || chr(10)) > 0 then substr(md, 5 + strpos(substr(md, 5), chr(10) || '---' || chr(10)) + 4) else md end"


def _roman(s: str) -> str:
    """DuckDB: value of a roman numeral."""
    value = "(case {} when 'I' then 1 when 'V' then 5 when 'X' then 10 when 'L' then 50 when 'C' then 100 else 0 end)"
    at = lambda i: value.format(f"upper(substr({s}, {i}, 1))")
    return f"(select sum(case when {at('i')} < {at('i + 1')} then -{at('i')} else {at('i')} end) from range(1, length({s}) + 1) t(i))"


def _table_id(x: str) -> str:
    rest = f"substr({x}, 2)"
    return f"(case when regexp_matches({x}, '^[Ss][0-9]+$') then {x} when regexp_matches({x}, '^[Ss][IVXLCivxlc]+$') then substr({x}, 1, 1) || cast({_roman(rest)} as varchar) when regexp_matches({x}, '^[IVXLCivxlc]+$') then cast({_roman(x)} as varchar) else {x} end)"


_FIGURES = r"list_sort(list_distinct(regexp_extract_all(body, '(?i)(?:^|[^\w-])(?:Extended\s+Data\s+)?(?:Figure|Fig\.?)\s+(S?\d+|[A-Z]\d+|[A-Z]\.\d+)', 1)))"
_TABLES = r"list_sort(list_distinct(regexp_extract_all(body, '(?i)(?:^|[^\w-])(?:Supplementary\s+|Supp\.\s+)?Table\s+(S?\d+|S?[IVXLC]+|[A-Z]\d+|[A-Z]\.\d+)', 1)))"
_INSERTED = r"list_sort(list_distinct(list_concat(regexp_extract_all(body, '(?im)^\s*\**\s*Table\s+(S?\d+|S?[IVXLC]+|[A-Z]\d+|[A-Z]\.\d+)\b\s*[:.*|]', 1), regexp_extract_all(body, '(?i)\[Table\s+(S?\d+|S?[IVXLC]+|[A-Z]\d+|[A-Z]\.\d+)\s+[-—]\s+separate\s+markdown\]', 1))))"
_AUDITED = f"""
  select doc_id, {_FIGURES} as fr, {_TABLES} as tr, {_INSERTED} as ti,
    len(list_filter(regexp_extract_all(body, '(?m)^\\s*!\\[[^\\]]*\\]\\(([^)]+)\\)\\s*$', 1), lambda p: not starts_with(lower(regexp_extract(p, '([^/]*)$', 1)), 'table_'))) as fi
  from (select doc_id, {_BODY} as body from {plain(inputs.AUDIT)})"""
_CANON = "(select count(distinct " + _table_id("x") + ") from unnest({}) u(x))"


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = made(spark, sf_dir, inputs.AUDIT).withColumn("body", markdown.body(F.col("md")))
    return audit.audited(docs)


@query(
    f"""select doc_id, array_to_string(fr, ',') as figures_referenced, cast(fi as integer) as figures_inserted, array_to_string(tr, ',') as tables_referenced,
    array_to_string(ti, ',') as tables_inserted, len(fr) > fi as figure_mismatch, {_CANON.format("tr")} > {_CANON.format("ti")} as table_mismatch from ({_AUDITED})"""
)
def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter off, ids referenced and inserted, mismatch flags: one row a document."""
    a = _audited(spark, sf_dir)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return a.select("doc_id", joined("figures_referenced"), "figures_inserted", joined("tables_referenced"), joined("tables_inserted"), "figure_mismatch", "table_mismatch")



def _case_rules(column: str, rules: list[tuple[str, str]], otherwise: str = "null") -> str:
    return "(case " + " ".join(f"when regexp_matches({column}, '{p}', 'i') then '{v}'" for p, v in rules) + f" else {otherwise} end)"


_CLEAN = "regexp_replace(lower(trim({})), '[.,;)>\\]]+$', '')"


@query(
    rf"""select doc_id, doi, arxiv_id, {_case_rules("doi", JOURNALS)} as journal_slug from (
    select doc_id, case when regexp_matches(raw, '^(10\.0/|10\.0000/|10\.5555/)') or raw = '' then null else raw end as doi, nullif(regexp_extract(page, '(?i)\barXiv:(\d{{4}}\.\d{{4,5}})', 1), '') as arxiv_id
    from (select doc_id, page, {_CLEAN.format("coalesce(nullif(regexp_extract(page, '(?i)doi\\.org/(10\\.\\d{4,9}/[^\\s\"<>]+)', 1), ''), regexp_extract(page, '(?i)\\b(10\\.\\d{4,9}/[^\\s\"<>]+)', 1))")} as raw from {plain(inputs.FRONT_PAGES)}))"""
)
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOI, arXiv id and journal of each first page."""
    pages = made(spark, sf_dir, inputs.FRONT_PAGES)
    doi = identity.doi_in(F.col("page"))
    return pages.select("doc_id", doi.alias("doi"), identity.arxiv_in(F.col("page")).alias("arxiv_id"), identity.journal(doi).alias("journal_slug"))


_LICENCE = r"""(case when s = '' then null
    when regexp_matches(s, '^cc(0|-by|-by-sa|-by-nc|-by-nd|-by-nc-sa|-by-nc-nd)(-\d+\.\d+)?$') then s
    when s in ('public-domain', 'publicdomain', 'pd') then 'public-domain' when s in ('arxiv-default', 'arxiv') then 'arxiv-default'
    when s in ('mit', 'pmc-author-manuscript', 'green-oa-no-license', 'osti-public-access', 'public-domain-us') then s
    when regexp_matches(s, 'creativecommons\.org/publicdomain/zero') then 'cc0' when regexp_matches(s, 'creativecommons\.org/publicdomain/mark') then 'public-domain'
    when regexp_matches(s, 'creativecommons\.org/licenses/(by-nc-sa|by-nc-nd|by-nc|by-nd|by-sa|by)/\d+\.\d+') then 'cc-' || regexp_extract(s, 'licenses/([a-z-]+)/', 1) || '-' || regexp_extract(s, 'licenses/[a-z-]+/(\d+\.\d+)', 1)
    when regexp_matches(s, 'creativecommons\.org/licenses/(by-nc-sa|by-nc-nd|by-nc|by-nd|by-sa|by)') then 'cc-' || regexp_extract(s, 'licenses/(by-nc-sa|by-nc-nd|by-nc|by-nd|by-sa|by)', 1)
    when regexp_matches(s, 'arxiv\.org/licenses/nonexclusive-distrib') then 'arxiv-default' when regexp_matches(s, 'opensource\.org/licenses/mit') then 'mit'
    when regexp_matches(s, 'www\.elsevier\.com/.*/tdm') then 'elsevier-tdm' end)"""


@query(
    rf"""select doc_id, license, case when base in ('cc0', 'public-domain', 'public-domain-us', 'cc-by', 'cc-by-sa', 'mit') then 'true' when base in ('cc-by-nc', 'cc-by-nd', 'cc-by-nc-sa', 'cc-by-nc-nd') then 'restricted'
    when base in ('arxiv-default', 'arxiv-pre-2004', 'pmc-author-manuscript', 'osti-public-access', 'green-oa-no-license') then 'readable' else 'false' end as safe_to_distribute,
    case when base like 'cc-by%' then 'https://creativecommons.org/licenses/' || substr(base, 4) || '/4.0/' when base = 'cc0' then 'https://creativecommons.org/publicdomain/zero/1.0/'
    when base = 'public-domain' then 'https://creativecommons.org/publicdomain/mark/1.0/' when base = 'arxiv-default' then 'https://arxiv.org/licenses/nonexclusive-distrib/1.0/'
    when base = 'elsevier-tdm' then 'https://www.elsevier.com/about/policies/text-and-data-mining' end as license_url
    from (select *, regexp_replace(license, '-\d+\.\d+$', '') as base from (select doc_id, {_LICENCE} as license from (select doc_id, lower(trim(raw)) as s from {plain(inputs.LICENCES)})))"""
)
def licence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence slug, how freely it may be passed on, and its address."""
    slug = identity.licence(F.col("raw"))
    return made(spark, sf_dir, inputs.LICENCES).select("doc_id", slug.alias("license"), identity.safety(slug).alias("safe_to_distribute"), identity.licence_home(slug).alias("license_url"))


@query(r"""select doc_id, regexp_extract(text, '(?i)(released under the [A-Za-z0-9 .-]*licen[sc]e|licensed under the [A-Za-z0-9 ,.-]*licen[sc]e[^\n.]*)', 1) as line from documents where regexp_matches(text, '(?i)(released under the [A-Za-z0-9 .-]*licen[sc]e|licensed under the [A-Za-z0-9 ,.-]*licen[sc]e[^\n.]*)')""")
def licence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements in the real documents."""
    pattern = r"(?i)(released under the [A-Za-z0-9 .-]*licen[sc]e|licensed under the [A-Za-z0-9 ,.-]*licen[sc]e[^\n.]*)"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.where(F.col("text").rlike(pattern)).select("doc_id", F.regexp_extract("text", pattern, 1).alias("line"))


@query(
    rf"""with l as (select doc_id, i - 1 as line_no, lines[i] as line from (select doc_id, string_split(md, chr(10)) as lines from {plain(inputs.DEPOSITS)}), unnest(range(1, len(lines) + 1)) u(i)),
    m as (select *, regexp_matches(line, '^\s*#+\s+') as h, regexp_matches(line, '(?i)^\s*(#+\s*\**|\*\*)\s*((data|code)\s+and\s+(code|data)|data|code)\s+(availability|accessibility|access|sharing)(\s+statement)?\s*\**\s*[:.]?\s*\**\s*$') as a from l),
    s as (select *, coalesce(max(case when h then line_no end) over w, -1) as h0 from m window w as (partition by doc_id order by line_no)),
    t as (select s.*, (select min(b.line_no) from m b where b.doc_id = s.doc_id and b.a and b.line_no between s.h0 and s.line_no) as sl from s),
    x as (select t.doc_id, t.line_no, t.line, trim(regexp_replace(regexp_replace(trim(b.line), '^#+', ''), '^[\s*]+|[\s*]+$', '', 'g')) as section from t left join m b on b.doc_id = t.doc_id and b.line_no = t.sl),
    f as (
      select doc_id, line_no, section, 0 as rule, 0 as form, 'zenodo' as repository, 'https://zenodo.org/records/' as u, '10.5281/zenodo.' as d, '' as e, unnest(regexp_extract_all(line, '(?i)\b10\.5281/zenodo\.(\d+)\b', 1)) as id from x
      union all select doc_id, line_no, section, 0, 1, 'zenodo', 'https://zenodo.org/records/', '10.5281/zenodo.', '', unnest(regexp_extract_all(line, '(?i)zenodo\.org/(?:records?|deposit)/(\d+)', 1)) from x
      union all select doc_id, line_no, section, 1, 0, 'dryad', 'https://datadryad.org/dataset/doi:10.5061/dryad.', '10.5061/dryad.', '', unnest(regexp_extract_all(line, '(?i)\b10\.5061/dryad\.([a-z0-9]+)', 1)) from x
      union all select doc_id, line_no, section, 4, 1, 'figshare', 'https://figshare.com/articles/', '10.6084/m9.figshare.', '', unnest(regexp_extract_all(line, '(?i)figshare\.com/articles/(?:[^/]+/)*[^/]+/(\d+)', 1)) from x
      union all select doc_id, line_no, section, 5, 1, 'osf', 'https://osf.io/', '10.17605/OSF.IO/', '/', unnest(regexp_extract_all(line, '(?i)osf\.io/([a-z0-9]{{5,8}})', 1)) from x
      union all select doc_id, line_no, section, 8, 0, 'mendeley-data', 'https://data.mendeley.com/datasets/', '10.17632/', '', unnest(regexp_extract_all(line, '(?i)\b10\.17632/([a-z0-9]+)\.\d+\b', 1)) from x
      union all select doc_id, line_no, section, 9, 0, 'icpsr', 'https://www.icpsr.umich.edu/web/ICPSR/studies/', '10.3886/ICPSR', '', unnest(regexp_extract_all(line, '\b10\.3886/ICPSR(\d+)\b', 1)) from x
      union all select doc_id, line_no, section, 10, 1, 'caltechdata', 'https://data.caltech.edu/records/', '10.22002/', '', unnest(regexp_extract_all(line, '(?i)data\.caltech\.edu/records?/([a-z0-9-]+)', 1)) from x)
    select doc_id, arg_min(repository, rule * 1000 + form * 100 + line_no) as repository, arg_min(u || id || e, rule * 1000 + form * 100 + line_no) as url, arg_min(d || id, rule * 1000 + form * 100 + line_no) as doi, arg_min(id, rule * 1000 + form * 100 + line_no) as record_id,
      arg_min(section, rule * 1000 + form * 100 + line_no) filter (where section is not null) as section, case when count(section) > 0 then 'high' else 'medium' end as confidence
    from f group by doc_id, lower(d || id)"""
)
def data_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deposits that a text names, with section and confidence."""
    return links.data_links(made(spark, sf_dir, inputs.DEPOSITS))


@query(
    r"""select doc_id, regexp_matches(t, '(?i)^\s*(?:(?:\(\s*[a-h]\s*\)|[a-h]\s*\)|[a-h])\s+)?(?:Extended\s+Data\s+)?(?:Figure|Fig\.?)\s+\d+(?:\s*[|.,:]\s*|\s+[A-Z(])\S?.{9,}') and not regexp_matches(t, '^\S+ \d+$') as is_primary,
    trim(t) = '' or regexp_matches(t, '(?i)^\s*(?:\(\s*[a-h]\s*\)\s*|[a-h]\s*\)?(?:\s+[a-h]\s*\)?)*\s*|(?:Extended\s+Data\s+)?(?:Figure|Fig\.?)\s+\d+\s*)$') as is_stub,
    regexp_matches(substr(t, 1, 100), '(?i)(?:Fig|Figure|Table|Plate|Scheme|Box)\.?\s*[A-Z]?\d+') as is_caption,
    regexp_matches(t, '^\s*(?:[*†‡§¶#]|[a-z]\)\s|\(\d+\)\s|\d+\)\s|Notes?\s*[:.])') as is_footnote,
    regexp_matches(t, '(?i)downloaded\s+from|www\.[a-z0-9-]+\.(com|org)|nature\.com') as is_watermark,
    try_cast(nullif(regexp_extract(t, '(?i)^\s*(?:(?:\(\s*[a-h]\s*\)|[a-h]\s*\)|[a-h])\s+)?(?:Extended\s+Data\s+)?(?:Figure|Fig\.?)\s+(\d+)', 1), '') as integer) as figure_number,
    nullif(lower(regexp_extract(t, '(?i)^\s*\(?\s*([a-h])\s*\)?\s+(?:Figure|Fig\.?)\s+\d+', 1)), '') as letter
    from (select doc_id, coalesce(text, '') as t from """
    + plain(inputs.CAPTIONS)
    + ")"
)
def caption_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each caption is, its figure number and panel letter."""
    t = F.col("text")
    return made(spark, sf_dir, inputs.CAPTIONS).select("doc_id", cap.is_primary(t).alias("is_primary"), cap.is_stub(t).alias("is_stub"), cap.is_caption(t).alias("is_caption"), cap.is_footnote(t).alias("is_footnote"), cap.is_watermark(t).alias("is_watermark"), cap.figure_number(t).alias("figure_number"), cap.panel_letter(t).alias("letter"))


@query(
    r"""select doc_id, case when t is null or t = '' or regexp_matches(t, '^\s*(?i:Fig(?:ure)?|Table|Plate|Scheme|Box)\.?\s*\d+[A-Za-z]?\.\s') or not regexp_matches(t, '(?i:Fig(?:ure)?|Table|Plate|Scheme|Box)\.?\s*\d+[A-Za-z]?\.[A-Za-z][a-z]') then t
    when ends_with(rtrim(b), '-') then l || ' ' || rtrim(rtrim(b), '-') || a else l || ' ' || rtrim(b) || ' ' || a end as repaired
    from (select doc_id, text as t, regexp_extract(text, '(?s)^(.*?)(?:(?i:Fig(?:ure)?|Table|Plate|Scheme|Box)\.?\s*\d+[A-Za-z]?\.)[A-Za-z][a-z].*$', 1) as b, regexp_extract(text, '(?s)^.*?((?i:Fig(?:ure)?|Table|Plate|Scheme|Box)\.?\s*\d+[A-Za-z]?\.)[A-Za-z][a-z].*$', 1) as l,
      regexp_extract(text, '(?s)^.*?(?i:Fig(?:ure)?|Table|Plate|Scheme|Box)\.?\s*\d+[A-Za-z]?\.([A-Za-z][a-z].*)$', 1) as a from """
    + plain(inputs.CAPTIONS)
    + ")"
)
def caption_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels merged into the middle of a caption go to its front."""
    return made(spark, sf_dir, inputs.CAPTIONS).select("doc_id", cap.repair_label(F.col("text")).alias("repaired"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = made(spark, sf_dir, inputs.BLOCKS)
    return b.withColumn("bbox", F.struct(*(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))).drop("x0", "y0", "x1", "y1").withColumn("footnote", F.col("footnote").cast("string"))


_NEAR = rf"""with b as (select * from {plain(inputs.BLOCKS)}),
    p as (select * from b where type in ('image', 'chart', 'table')), t as (select * from b where type = 'text' and text <> ''),
    j as (select p.doc_id, p.page_idx, p.idx as parent, t.idx as child, t.text,
      case when t.y1 <= p.y0 then p.y0 - t.y1 when t.y0 >= p.y1 then t.y0 - p.y1 else 0.0 end as gap,
      coalesce(p.text, '') = '' or (regexp_matches(p.text, '(?i)www\.|science\.org') and not regexp_matches(p.text, '(?i)^(fig|figure|table)')) as wc, p.type = 'table' and coalesce(p.footnote, '') = '' as wf
      from p join t using (doc_id, page_idx)
      where ((t.y1 <= p.y0 + 0.5 and p.y0 - t.y1 <= 60) or (t.y0 >= p.y1 - 0.5 and t.y0 - p.y1 <= 60) or least(p.y1, t.y1) > greatest(p.y0, t.y0))
        and (greatest(0, least(p.x1, t.x1) - greatest(p.x0, t.x0)) / greatest(1, p.x1 - p.x0) >= 0.4 or greatest(0, least(p.x1, t.x1) - greatest(p.x0, t.x0)) / greatest(1, t.x1 - t.x0) >= 0.4 or (t.x1 - t.x0) / 612 > 0.6 or (greatest(t.x0 - p.x1, p.x0 - t.x1) >= 0 and greatest(t.x0 - p.x1, p.x0 - t.x1) < 50))
        and t.y1 - t.y0 <= 500),
    w as (select *, 'caption' as what from j where wc and regexp_matches(substr(text, 1, 100), '(?i)(fig|figure|table|plate|scheme|box)\.?\s*[A-Z]?\d+')
      union all select *, 'footnote' from j where wf and regexp_matches(text, '^\s*(?:[*†‡§¶#]|[a-z]\)\s|\(\d+\)\s|\d+\)\s|Notes?\s*[:.])')),
    n as (select doc_id, page_idx, parent, child, text, what, cast(gap as double) as gap, row_number() over (partition by doc_id, page_idx, parent, what order by gap, child) as r from w)
    """


@query(_NEAR + "select doc_id, page_idx, parent, child, text, what, gap from n where r = 1")
def nearest_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest caption and footnote of every figure and table that lacks one."""
    return rescue.nearest(_blocks(spark, sf_dir))


@query(_NEAR + "select doc_id, page_idx, parent, child, what from n where r = 1")
def adopted_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adoption in page order, each text once; here no two parents want the same text."""
    return rescue.adopted(_blocks(spark, sf_dir)).select("doc_id", "page_idx", "parent", "child", "what")


@query(
    f"""select doc_id, page_idx, sum(n) >= 4 and count(*) >= 3 and max(n) < 0.8 * sum(n) as three_columns from (
    select doc_id, page_idx, floor((x0 + x1) / 2 / 102.0) as bin, count(*) as n from {plain(inputs.BLOCKS)} where type in ('text', 'ref_text') group by all) group by doc_id, page_idx"""
)
def three_column_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescue.three_columns(_blocks(spark, sf_dir))


@query()
def rescued_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks after caption rescue by place and by label."""
    return rescue.with_captions(_blocks(spark, sf_dir)).select("doc_id", "page_idx", "idx", "type", "text", "footnote")


@query(
    f"""select doc_id, 1 as page_idx, 2 as "primary", idx as stub, case when text = 'Fig. ' || cast(doc_id % 5 + 1 as varchar) then 'number' else 'flow' end as how from {plain(inputs.BLOCKS)} where page_idx = 1 and type in ('image', 'chart') and idx <> 2"""
)
def subpanels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels and the figure they belong to."""
    return rescue.panels(_blocks(spark, sf_dir)).where("page_idx = 1")


@query(
    f"""select doc_id, 'Figure ' as k, 'c,a,b,d' as letters, 'p3.jpg,p1.jpg,p2.jpg,p4.jpg' as paths, cast(doc_id % 5 + 1 as integer) as figure_number from {plain(inputs.BLOCKS)} where page_idx = 1 and idx = 2"""
)
def panel_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidated figures with panel letters: the primary keeps its own."""
    g = rescue.panel_groups(_blocks(spark, sf_dir)).where("page_idx = 1")
    return g.select("doc_id", F.lit("Figure ").alias("k"), F.array_join("letters", ",").alias("letters"), F.array_join("paths", ",").alias("paths"), "figure_number")


@query(
    rf"""with l as (select doc_id, made_as, md, i as k, lines[i] as line, length(array_to_string(lines[1:i - 1], chr(10))) + case when i > 1 then 1 else 0 end as off from (select *, string_split(md, chr(10)) as lines from {plain(inputs.REFERENCES)}), unnest(range(1, len(lines) + 1)) u(i)),
    n as (select doc_id, length(md) as size, off, md, case when regexp_matches(line, '^\d{{1,3}}[A-Z]\.\s') then 'footnote' when regexp_matches(line, '^[ \t]*\[\d{{1,3}}\]\s+\S') then 'bracketed' when regexp_matches(line, '^[ \t]*\d{{1,3}}[.)]\s+\S') then 'numbered' when regexp_matches(line, '^[A-Z][A-Za-z.,& -]{{1,120}}(\([12]\d{{3}}[a-z]?\)|,\s+[12]\d{{3}}[a-z]?[.,])') then 'author-year' end as style, try_cast(regexp_extract(line, '(\d{{1,3}})', 1) as integer) as num from l),
    g as (select doc_id, style, count(*) as c, min(off) as first from n where style is not null and ((style = 'author-year' and off >= floor(size * 0.75)) or (style <> 'author-year' and off >= floor(size * 0.7))) group by doc_id, style),
    a as (select n.doc_id, n.style, min(n.off) as off from n join g using (doc_id, style) where (n.style = 'footnote' and c >= 5 and n.num = 1) or (n.style in ('bracketed', 'numbered') and c >= 5 and n.num in (1, 2, 3) and n.off >= floor(size * 0.7)) or (n.style = 'author-year' and c >= 10 and n.off = g.first) group by n.doc_id, n.style)
    select d.doc_id, a.style, cast(a.off as integer) as off from {plain(inputs.REFERENCES)} d left join a using (doc_id)"""
)
def reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a trailing reference list begins, and its style."""
    s = references.list_start(F.col("md"))
    return made(spark, sf_dir, inputs.REFERENCES).select("doc_id", s["style"].alias("style"), s["off"].alias("off"))


@query()
def reference_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts after the heading rescue, scored before and after."""
    docs = made(spark, sf_dir, inputs.REFERENCES).select("doc_id", "made_as", "md")
    before = references.scored(docs).select("doc_id", "made_as", "md", F.col("score").alias("score_before"))
    return references.scored(references.headed(before)).select("doc_id", "made_as", "score_before", "score", "style", "entry_count", "section_count", "numbered_continuous", "year_hit_ratio", "longest_over_median")


@query(
    rf"""with l as (select doc_id, i, lines[i] as line from (select doc_id, string_split(md, chr(10)) as lines from {plain(inputs.DIRTY)}), unnest(range(1, len(lines) + 1)) u(i))
    select doc_id, regexp_replace(regexp_replace(string_agg(line, chr(10) order by i), '\\label\{{[^}}]*\}}', '', 'g'), '\\eqref\{{([^}}]*)\}}', '(\1)', 'g') as md from l
    where not regexp_matches(line, '^\s*\d{{1,4}}\s*$') and not regexp_matches(line, 'ET AL\. \d+ of \d+$') and not regexp_matches(line, '^\*\*LETTERS\*\*$|^NATURE GEOSCIENCE DOI') and not regexp_matches(line, '^onlinelibrary|^See the Terms') group by doc_id"""
)
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers, running footers, page headers, stamps and math labels off."""
    return made(spark, sf_dir, inputs.DIRTY).select("doc_id", rewrites.cleaned(F.col("md")).alias("md"))


@query(r"""select page_id, case when length(p) > 600 then rtrim(substr(p, 1, 600)) || '...' else p end as plain, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, cast(len(regexp_extract_all(html, '<a href')) as integer) as links, regexp_extract(url, '^https?://([^/]+)', 1) as host from (select *, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) as p from pages)""")
def page_plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real pages: markup off, squeezed, cut at 600 characters; title, links, host."""
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(h).alias("plain"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href")).alias("links"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("select doc_id, case when doc_id % 4 = 0 then '1,3-5' when doc_id % 4 = 1 then '2-3' when doc_id % 4 = 2 then '9' else '3,1-2,2' end as selection, case when doc_id % 4 = 0 then '0,2,3,4' when doc_id % 4 = 1 then '1,2' when doc_id % 4 = 3 then '0,1,2' end as pages, case when doc_id % 4 = 0 then '_p1+3+4+5' when doc_id % 4 = 1 then '_p2-3' when doc_id % 4 = 3 then '_p1-3' end as suffix from documents")
def page_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections of five-page documents; one is out of range."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "1,3-5").when(F.col("doc_id") % 4 == 1, "2-3").when(F.col("doc_id") % 4 == 2, "9").otherwise("3,1-2,2").alias("selection"))
    pages = markdown.selected_pages(F.col("selection"), F.lit(5))
    return d.select("doc_id", "selection", F.array_join(F.transform(pages, lambda p: p.cast("string")), ",").alias("pages"), F.when(pages.isNotNull(), markdown.subset_suffix(pages)).alias("suffix"))


def _layout_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = """select doc_id, '{"_backend":"p","pdf_info":[{"page_idx":0,"page_size":[612,792],"para_blocks":[{"type":"title","index":0,"bbox":[1,2,3,4],"level":1,"lines":[{"spans":[{"type":"text","content":"Paper ' || cast(doc_id as string) || '"}]}]},{"type":"text","index":1,"bbox":[1,20,3,40],"lines":[{"spans":[{"type":"text","content":"spin-"}]},{"spans":[{"type":"text","content":"ning at"},{"type":"inline_equation","content":"v' || cast(doc_id % 9 as string) || '"}]}]},{"type":"image","index":2,"bbox":[1,50,3,90],"blocks":[{"type":"image_caption","bbox":[9,92,10,95],"lines":[{"spans":[{"type":"text","content":"right part"}]}]},{"type":"image_caption","bbox":[1,92,5,95],"lines":[{"spans":[{"type":"text","content":"Fig. 1. Left"}]}]},{"type":"image_body","bbox":[1,50,3,90],"lines":[{"spans":[{"type":"image","image_path":"a.jpg"}]}]}]},{"type":"odd","index":3}],"discarded_blocks":[{"type":"page_footnote","bbox":[1,700,3,710],"lines":[{"spans":[{"type":"text","content":"1 A. Smith (1960)"}]}]},{"type":"footer","lines":[{"spans":[{"type":"text","content":"x"}]}]}]}]}' as json from {docs}"""
    return spark.sql("select doc_id from {_t}", _t=table(spark, sf_dir, "documents")).selectExpr("doc_id", sql.split("select doc_id, ", 1)[1].rsplit(" as json", 1)[0] + " as json")


@query(
    """select doc_id, 0 as page_idx, idx, type, case idx when 0 then 'Paper ' || cast(doc_id as varchar) when 1 then 'spinning at $v' || cast(doc_id % 9 as varchar) || '$' else 'Fig. 1. Left right part' end as text, case idx when 2 then 'a.jpg' end as image_path, case idx when 0 then 1 end as text_level
    from documents, (values (0, 'title'), (1, 'text'), (2, 'image')) b(idx, type)"""
)
def layout_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout JSON to blocks: de-hyphenated lines, formulas, caption fragments in reading order."""
    pages = layout.parsed(_layout_json(spark, sf_dir))
    return layout.blocks(pages).select("doc_id", "page_idx", "idx", "type", "text", "image_path", "text_level")


@query("select doc_id, 0 as page_idx, 700.0::double as y0, '1 A. Smith (1960)' as text, 612.0::double as width, 792.0::double as height from documents")
def layout_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page footnotes and page sizes of layout JSON; footers are left out."""
    pages = layout.parsed(_layout_json(spark, sf_dir))
    return layout.footnotes(pages).join(layout.page_sizes(pages), ["doc_id", "page_idx"])


@query(
    f"""with n as (select *, case when type in ('image', 'chart', 'table') then row_number() over (partition by doc_id, type order by page_idx, idx) end as number from {plain(inputs.BLOCKS)}),
    m as (select *, case when type = 'title' then '## ' || trim(text) when type in ('image', 'chart') then
      case when image_path is not null then '![' || translate(trim(regexp_replace(coalesce(nullif(text, ''), 'Figure ' || cast(number as varchar)), '[ \\t\\n]+', ' ', 'g')), '[]', '()') || '](assets/' || image_path || ')' || chr(10) || chr(10) else '' end || '*' || coalesce(nullif(text, ''), 'Figure ' || cast(number as varchar)) || '*'
      when type = 'table' then null else trim(text) end as md from n)
    select doc_id, string_agg(md, chr(10) || chr(10) order by page_idx, idx) as md from m where md <> '' group by doc_id"""
)
def assembled_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in reading order as markdown."""
    return emit.assembled(_blocks(spark, sf_dir))


@query(
    """with c as (select doc_id, doc_id % 4 as figure, 10 + doc_id % 3 as line_no from documents), i as (select doc_id, k as figure, 'f' || cast(k as varchar) || '.jpg' as path, cast(doc_id % 9 as integer) as words, 1 as nth from documents, (values (0), (1), (2)) v(k)
      union all select doc_id, doc_id % 4, 'g.jpg', 9, 2 from documents where doc_id % 4 < 3 and doc_id % 5 = 0)
    select doc_id, cast(figure as varchar) as figure, cast(c.line_no as integer) as line_no, i.path, case when path is null then 'left-only' when line_no is null then 'end-of-document' when nth > 1 then 'duplicate' else 'spliced' end as placed,
      case when path is null then null when line_no is null then 1.0 when nth > 1 then 0.6 when words < 5 then 0.7 else 1.0 end::double as score from c full join i using (doc_id, figure)"""
)
def spliced_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources' figures by number: spliced, dropped, appended or left alone."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    left = d.select("doc_id", (F.col("doc_id") % 4).cast("string").alias("figure"), (10 + F.col("doc_id") % 3).cast("int").alias("line_no"))
    three = d.select("doc_id", F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("k")).select("doc_id", F.col("k").cast("string").alias("figure"), F.concat(F.lit("f"), F.col("k").cast("string"), F.lit(".jpg")).alias("path"), (F.col("doc_id") % 9).cast("int").alias("words"))
    more = d.where("doc_id % 4 < 3 and doc_id % 5 = 0").select("doc_id", (F.col("doc_id") % 4).cast("string").alias("figure"), F.lit("g.jpg").alias("path"), F.lit(9).alias("words"))
    return matching.spliced_figures(left, three.unionByName(more))


@query(
    """select doc_id, overall, case when overall >= 0.9 then 'A' when overall >= 0.8 then 'B' when overall >= 0.7 then 'C' when overall >= 0.6 then 'D' else 'F' end as grade, n_tables, clean, redone, n_tables - clean - redone as fallback, n_figures, captioned from (
    select d.doc_id, round(case when t.s is not null and f.s is not null then 0.6 * t.s + 0.4 * f.s else coalesce(t.s, f.s, 0.0) end, 4) as overall, coalesce(t.n, 0) as n_tables, coalesce(t.c, 0) as clean, coalesce(t.r, 0) as redone, coalesce(f.n, 0) as n_figures, coalesce(f.c, 0) as captioned from documents d
    left join (select doc_id, avg(s) as s, count(*) as n, count(*) filter (where s >= 0.9) as c, count(*) filter (where r) as r from (select doc_id, case (doc_id + k) % 3 when 0 then 1.0 when 1 then 0.85 else 0.45 end as s, (doc_id + k) % 3 = 1 as r from documents, (values (0), (1)) v(k) where doc_id % 3 > 0) group by doc_id) t using (doc_id)
    left join (select doc_id, avg(case when doc_id % 2 = 0 then 1.0 else 0.6 end) as s, count(*) as n, count(*) filter (where doc_id % 2 = 0) as c from documents where doc_id % 4 > 0 group by doc_id) f using (doc_id))"""
)
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall score, grade and summary counts."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    k = (F.col("doc_id") + F.col("k")) % 3
    t = d.where("doc_id % 3 > 0").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select("doc_id", F.when(k == 0, 1.0).when(k == 1, 0.85).otherwise(0.45).alias("score"), (k == 1).alias("redone"))
    f = d.where("doc_id % 4 > 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.6).alias("score"), (F.col("doc_id") % 2 == 0).alias("captioned"))
    return scoring.document_scores(t, f, d)


@query(
    """with s as (select doc_id, 0 as page_idx, substr(coalesce(text, ''), cast(k * (length(coalesce(text, '')) // 4 + 1) + 1 as integer), cast(length(coalesce(text, '')) // 4 + 1 as integer)) as t, 8 + (doc_id + k) % 5 * 0.5 as size, case when (doc_id + k) % 7 = 0 then 1 when (doc_id + k) % 5 = 0 then 16 else 4 end as flags from documents, (values (0), (1), (2), (3)) v(k)),
    a as (select doc_id, sum(length(t)) as chars, count(*) as n, count(distinct size) as sizes, count(*) filter (where flags & 1 <> 0) as supers, count(*) filter (where flags & 19 <> 0) as styled from s group by doc_id)
    select doc_id, coalesce(chars, 0)::double as chars_per_page, coalesce(sizes, 0) as distinct_font_sizes, coalesce(supers, 0) as super_flag_count, coalesce(styled / n, 0)::double as style_flag_pct,
      case when coalesce(chars, 0) < 60 then 'sparse-text-layer' when coalesce(supers, 0) = 0 then 'no-super-flags-preserved' when sizes < 4 then 'no-heading-discrimination' else 'clean-modern-text-layer' end as reason from documents left join a using (doc_id)"""
)
def text_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-layer figures of made-up spans, and the route they lead to."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id") + F.col("k")
    part = F.floor(F.length(F.coalesce("text", F.lit(""))) / 4).cast("int") + 1
    s = d.select("doc_id", "text", F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("k")).select("doc_id", F.lit(0).alias("page_idx"), F.substring(F.coalesce("text", F.lit("")), F.col("k") * part + 1, part).alias("text"), (8 + k % 5 * 0.5).alias("size"), F.when(k % 7 == 0, 1).when(k % 5 == 0, 16).otherwise(4).alias("flags"))
    r = scoring.text_layer(s, d.select("doc_id", F.lit(3).alias("n_pages"), F.lit(1).alias("probed")))
    route = scoring.routing(F.lit(None).cast("string"), F.col("pages"), F.col("chars_per_page"), F.col("super_flag_count"), F.col("distinct_font_sizes"), chars_min=60)
    return r.select("doc_id", "chars_per_page", "distinct_font_sizes", "super_flag_count", "style_flag_pct", route["reason"].alias("reason"))


@query("select doc_id, case when doc_id % 5 = 0 then 'maker' when doc_id % 7 > 4 and doc_id % 6 <= 3 then 'cover-and-fonts' when (case when doc_id % 7 > 2 then 1 else 0 end) + (case when doc_id % 6 <= 4 then 1 else 0 end) + (case when doc_id % 3 = 0 then 1 else 0 end) >= 2 then 'two-signs' end as scan from documents")
def scan_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m = table(spark, sf_dir, "documents"), lambda n: F.col("doc_id") % n
    cover = F.when(m(7) > 4, 0.7).when(m(7) > 2, 0.5).otherwise(0.1)
    return d.select("doc_id", scoring.scan_verdict(F.when(m(5) == 0, "ABBYY FineReader 9").otherwise("pdfTeX"), F.lit(None).cast("string"), cover, m(6), F.when(m(3) == 0, 0.4).otherwise(0.0)).alias("scan"))


_RUNS = """(select 'p' || cast(event_id as varchar) as pdf, event_type = 'view' as exists, value as elapsed_sec, case when event_id % 5 = 1 then 'RuntimeError: CUDA out of memory' when event_id % 5 = 2 then 'PDFSyntaxError' end as error, event_id % 3 = 0 as si_attempted, case when event_id % 6 = 0 then 'No space left on device' end as si_error, (event_id % 10) / 10.0 as overall from events)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = lambda k: F.col("event_id") % k
    return e.select(F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("pdf"), (F.col("event_type") == "view").alias("exists"), F.col("value").alias("elapsed_sec"), F.when(n(5) == 1, "RuntimeError: CUDA out of memory").when(n(5) == 2, "PDFSyntaxError").alias("error"), (n(3) == 0).alias("si_attempted"), F.when(n(6) == 0, "No space left on device").alias("si_error"), (n(10) / 10.0).alias("overall"))


_MANIFEST = f"""(select pdf, status, case when status = 'error' then case when error like '%CUDA%' then 'cuda_oom' else 'pdf_parse' end end as error_kind, si, case when si = 'error' then 'disk' end as si_error_kind from (
    select *, case when status not in ('error', 'timeout', 'skipped') and si_attempted then case when si_error is not null then 'error' else 'ok' end end as si from (
    select *, case when exists then 'skipped' when elapsed_sec > 3600 then 'timeout' when error is not null then 'error' when overall < 0.7 then 'low_quality' else 'ok' end as status from {_RUNS})))"""


@query(f"select pdf, status, error_kind, si as si_status, si_error_kind from {_MANIFEST}")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of a corpus run: skipped, timeout, error, low_quality, ok; a supplement has its own."""
    return batch.statuses(_runs(spark, sf_dir)).select("pdf", "status", "error_kind", "si_status", "si_error_kind")


@query(f"select status, count(*) as n from {_MANIFEST} group by status")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.status_counts(batch.statuses(_runs(spark, sf_dir))).select("status", "n")


@query(f"select error_kind, count(*) as n from {_MANIFEST} where status = 'error' group by error_kind")
def failure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.failure_groups(batch.statuses(_runs(spark, sf_dir)))


@query(f"select error_kind, pdf from {_MANIFEST} where status = 'error'")
def failed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.failed_files(batch.statuses(_runs(spark, sf_dir)))


@query(f"select pdf, case when status in ('error', 'timeout', 'low_quality') then status || case when si = 'error' then '+supplement' else '' end else 'supplement' end as why from {_MANIFEST} where status in ('error', 'timeout', 'low_quality') or si = 'error'")
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = batch.statuses(_runs(spark, sf_dir)).withColumns({"figure_mismatch": F.lit(False), "table_mismatch": F.lit(False)})
    return batch.work_list(m)


@query(
    """select 'paper' || cast(doc_id as varchar) || case when doc_id % 3 = 2 then '-maintext' else '' end as pdf, case when doc_id % 2 = 0 then 'paper' || cast(doc_id as varchar) || case when doc_id % 4 = 0 then '_SI' else '-supplement' end end as supplement, 'main' as role from documents
    union all select 'lone' || cast(doc_id as varchar) || '_SI', null, 'orphan-supplement' from documents where doc_id % 5 = 0"""
)
def supplement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mains with their supplements; supplements without a main stand alone."""
    d, s = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    m = lambda n: F.col("doc_id") % n
    stem = F.concat(F.lit("paper"), s)
    stems = F.array_compact(F.array(F.concat(stem, F.when(m(3) == 2, "-maintext").otherwise("")), F.when(m(2) == 0, F.concat(stem, F.when(m(4) == 0, "_SI").otherwise("-supplement"))), F.when(m(5) == 0, F.concat(F.lit("lone"), s, F.lit("_SI")))))
    return batch.paired(d.select(F.explode(stems).alias("stem")))


@query(
    """with t as (select c_mktsegment as paper, 'f' || cast(c_custkey as varchar) as filename, case when c_custkey % 6 = 0 then 'DROP' when c_custkey % 11 = 0 then 'TODO' else cast(c_custkey % 7 as varchar) end as expected, c_custkey as k from customer),
    r as (select c as condition, paper, filename, case when k % 5 = c_n then cast(k % 3 as varchar) else expected end as matched, expected = 'DROP' and k % 4 > 0 as dropped, k from t, (values ('one', 1), ('two', 2)) v(c, c_n) where k % 9 > 0),
    f as (select condition, paper, filename, case when matched in ('DROP', 'TODO') then null else matched end as matched, dropped from r),
    j as (select c.condition, t.paper, t.expected, f.filename is null as missed, f.matched, f.dropped from (select distinct condition, paper from f) c join t using (paper) left join f using (condition, paper, filename) where expected <> 'TODO'),
    d as (select condition, paper, count(*) as dup from (select *, row_number() over (partition by condition, paper, matched order by filename) as n from f where matched is not null and not dropped) where n > 1 group by condition, paper),
    g as (select condition, paper, count(*) as expected, count(*) filter (where case when expected = 'DROP' then coalesce(dropped, false) else coalesce(matched = expected, false) end) as "right", count(*) filter (where missed) as missed, coalesce(max(d.dup), 0) as duplicate from j left join d using (condition, paper) group by condition, paper)
    select coalesce(condition, 'ALL') as condition, coalesce(paper, 'ALL') as paper, cast(sum(expected) as bigint) as expected, cast(sum("right") as bigint) as "right", cast(sum(missed) as bigint) as missed, cast(sum(duplicate) as bigint) as duplicate, round(sum("right") / sum(expected), 4)::double as accuracy from g group by rollup (condition, paper)"""
)
def figure_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure matching against a truth set, with totals over papers and conditions."""
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("paper"), F.concat(F.lit("f"), k.cast("string")).alias("filename"), F.when(k % 6 == 0, "DROP").when(k % 11 == 0, "TODO").otherwise((k % 7).cast("string")).alias("expected"), k.alias("k"))
    r = t.where("k % 9 > 0").select("*", F.explode(F.array(F.struct(F.lit("one").alias("condition"), F.lit(1).alias("n")), F.struct(F.lit("two").alias("condition"), F.lit(2).alias("n")))).alias("c"))
    got = F.when(F.col("k") % 5 == F.col("c.n"), (F.col("k") % 3).cast("string")).otherwise(F.col("expected"))
    run = r.select("c.condition", "paper", "filename", F.when(~got.isin("DROP", "TODO"), got).alias("matched_figure"), ((F.col("expected") == "DROP") & (F.col("k") % 4 > 0)).alias("dropped"))
    return matching.figure_benchmark(t.drop("k"), run).drop("extra")


@query(
    """with referenced as (select doc_id, cast(doc_id % 6 as varchar) as table_id from documents union select doc_id, 'S1' from documents), inserted as (select doc_id, cast(doc_id % 6 as varchar) as table_id from documents where doc_id % 2 = 0),
    extracted as (select doc_id, x as table_id, p as page_idx, 0 as idx from documents, (values ('S1', 2), ('S1', 1), ('3', 4)) v(x, p))
    select doc_id, table_id, min(page_idx) as page_idx from referenced anti join inserted using (doc_id, table_id) join extracted using (doc_id, table_id) group by doc_id, table_id"""
    .replace("referenced anti join inserted using (doc_id, table_id)", "(select * from referenced r where not exists (select 1 from inserted i where i.doc_id = r.doc_id and i.table_id = r.table_id))")
)
def recoverable_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that a text refers to and lacks, but that were extracted."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    own = (F.col("doc_id") % 6).cast("string").alias("table_id")
    extracted = d.select("doc_id", F.explode(F.array(*(F.struct(F.lit(x).alias("table_id"), F.lit(p).alias("page_idx")) for x, p in (("S1", 2), ("S1", 1), ("3", 4))))).alias("e")).select("doc_id", "e.*", F.lit(0).alias("idx"))
    return matching.recoverable_tables(d.select("doc_id", own).unionByName(d.select("doc_id", F.lit("S1").alias("table_id"))), d.where("doc_id % 2 = 0").select("doc_id", own), extracted).select("doc_id", "table_id", "page_idx")


@query()
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML tables of every outcome: clean, sections, spans, nested, empty; markdown, reason, score, sidecar."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    cell = F.col("doc_id").cast("string")
    grid = "<table><tr><td>a</td><td>b</td></tr><tr><td>"
    html = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit(grid), cell, F.lit("</td><td>x|y</td></tr></table>"))).when(F.col("doc_id") % 6 == 1, F.concat(F.lit("<table><tr><td>a</td><td>b</td></tr><tr><td colspan=2>group</td></tr><tr><td><eq>x^2</eq></td><td>"), cell, F.lit("</td></tr></table>"))).when(F.col("doc_id") % 6 == 2, "<table><tr><td rowspan=2>a</td></tr></table>").when(F.col("doc_id") % 6 == 3, "<table><tr><td><table></table></td></tr></table>").when(F.col("doc_id") % 6 == 4, "").otherwise("<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>")
    t = d.select("doc_id", F.lit(0).alias("page_idx"), F.lit(1).alias("number"), F.when(F.col("doc_id") % 2 == 0, "A.1").alias("table_id"), F.lit("Table A.1. All").alias("caption"), html.alias("html"), F.lit("t.jpg").alias("image_path"), F.lit("Notes: n").alias("footnote"), F.lit(None).cast("string").alias("rewritten"))
    return tables.outcomes(t).select("doc_id", "outcome", "score", "pre_redo_reason", "post_redo_reason", "sidecar", "md")


@query(
    """with q as (select doc_id as query_id, 'The Title ' || cast(doc_id as varchar) as title from documents), i as (select query_id, p as pos, case when (query_id + p) % 4 = 0 then upper(title) || '!' else 'Other' end as title, case when query_id % 3 = 0 then 60 else 40 end - p as score, '10.1/' || cast(query_id as varchar) || '.' || cast(p as varchar) as doi from q, (values (1), (2), (3), (4), (5), (6)) v(p)),
    m as (select i.query_id, i.doi, pos, regexp_replace(lower(i.title), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(q.title), '[^a-z0-9]+', '', 'g') as ex, score from i join q using (query_id) where pos <= 5)
    select query_id, doi, case when ex then 'exact' else 'score' end as "by" from (select *, row_number() over (partition by query_id order by ex desc, pos) as r from m where ex or (pos = 1 and score >= 50)) where r = 1"""
)
def title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title search results: the exact title among the first five, or a high score."""
    d = table(spark, sf_dir, "documents")
    q = d.select(F.col("doc_id").alias("query_id"), F.concat(F.lit("The Title "), F.col("doc_id").cast("string")).alias("title"))
    i = q.select("*", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("pos")).select("query_id", "pos", F.when((F.col("query_id") + F.col("pos")) % 4 == 0, F.concat(F.upper("title"), F.lit("!"))).otherwise("Other").alias("title"), (F.when(F.col("query_id") % 3 == 0, 60).otherwise(40) - F.col("pos")).alias("score"), F.concat(F.lit("10.1/"), F.col("query_id").cast("string"), F.lit("."), F.col("pos").cast("string")).alias("doi"))
    return metadata.matched_by_title(q, i)


_ARTICLES = "(select doc_id, case when doc_id % 10 > 0 then '10.1103/physrevb.' || cast(doc_id as varchar) end as doi, case when doc_id % 10 = 0 then '1901.' || cast(10000 + doc_id as varchar) end as arxiv_id from documents)"


@query(
    f"""with a as (select * from {_ARTICLES}), s as (select doc_id, doi, arxiv_id,
      case when doi is null or doc_id % 3 = 0 then null when doc_id % 3 = 1 then 'cc-by' end as l1, case when doi is not null and doc_id % 3 > 0 then case when doc_id % 4 = 0 then 'green' else 'closed' end else 'unknown' end as s1,
      case when doi is not null and doc_id % 3 > 0 and doc_id % 4 = 0 then 'https://r.org/' || cast(doc_id as varchar) end as u1, case when doi is not null and doc_id % 3 > 0 then cast(1900 + doc_id % 120 as integer) end as year from a),
    u as (select *, doi is not null and doc_id % 5 = 0 and (l1 is null or u1 is null) as ask from s),
    v as (select *, coalesce(l1, case when ask and doc_id % 2 = 0 then 'cc-by-nc' end) as l2, case when ask and s1 = 'unknown' then 'gold' else s1 end as s2, coalesce(u1, case when ask then 'https://u.org/x.pdf' end) as u2 from u),
    w as (select *, doi is not null and doc_id % 7 = 0 and (l2 is null or u2 is null) as osti from v),
    x as (select *, coalesce(l2, case when osti then 'osti-public-access' end, case when arxiv_id is not null then 'arxiv-default' end) as l3, case when osti and u2 is null and s2 in ('unknown', 'closed') then 'green' else s2 end as s3, coalesce(u2, case when osti then 'https://osti.gov/f' end) as u3 from w),
    y as (select *, case when l3 is null and u3 is not null and s3 in ('green', 'bronze', 'gold', 'hybrid') then 'green-oa-no-license' else l3 end as l4 from x),
    z as (select *, case when (l4 is null or l4 in ('osti-public-access', 'green-oa-no-license')) and year + 95 < 2026 then 'public-domain-us' else l4 end as license from y)
    select doc_id, case when doi is not null then 'aps-prb' end as journal_slug, license, s3 as oa_status, u3 as oa_pdf_url, case when license in ('cc-by', 'public-domain-us') then 'true' when license = 'cc-by-nc' then 'restricted' when license is null then 'false' else 'readable' end as safe_to_distribute from z"""
)
def metadata_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence and open-access state from several services in order, each asked only for what is missing."""
    d, n = table(spark, sf_dir, "documents"), lambda k: F.col("doc_id") % k
    s = F.col("doc_id").cast("string")
    a = d.select("doc_id", F.when(n(10) > 0, F.concat(F.lit("10.1103/physrevb."), s)).alias("doi"), F.when(n(10) == 0, F.concat(F.lit("1901."), (10000 + F.col("doc_id")).cast("string"))).alias("arxiv_id"), F.lit("low").alias("confidence"))
    named = a.where("doi is not null")
    none = F.lit(None).cast("string")
    openalex = named.where("doc_id % 3 > 0").select("doi", F.when(n(3) == 1, "cc-by").alias("license"), F.when(n(4) == 0, "green").otherwise("closed").alias("oa_status"), F.when(n(4) == 0, F.concat(F.lit("https://r.org/"), s)).alias("oa_url"), (1900 + n(120)).cast("int").alias("year"))
    unpaywall = named.where("doc_id % 5 = 0").select("doi", F.when(n(2) == 0, "cc-by-nc").alias("license"), F.lit(True).alias("is_oa"), F.lit("https://u.org/x.pdf").alias("pdf_url"))
    europepmc = named.where("false").select("doi", none.alias("license"), none.alias("pmcid"), none.alias("has_pdf"), none.alias("is_open"), F.lit(None).cast("int").alias("year"))
    osti = named.where("doc_id % 7 = 0").select("doi", F.lit("1").alias("osti_id"), F.lit("https://osti.gov/f").alias("fulltext_url"))
    arxiv = a.where("arxiv_id is not null").select("arxiv_id", F.lit("arxiv").alias("license"))
    r = metadata.resolved(a, openalex, unpaywall, europepmc, osti, arxiv, as_of_year=2026)
    return r.select("doc_id", "journal_slug", "license", "oa_status", "oa_pdf_url", "safe_to_distribute")


@query(
    """with a as (select doc_id, p as page, k as id_n, case when (doc_id + p + k) % 4 = 0 then p * 3 + k + 57 end as captured from documents, (values (1), (2), (3)) x(p), (values (0), (1), (2)) y(k))
    select doc_id, page, id_n, captured, cast(p3.n as integer) as number from (select *, case when exists (select 1 from a b where b.doc_id = a.doc_id and b.captured is not null) then page * 3 + id_n + 57 end as n from a) p3"""
)
def renumbered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lost reference numbers from those that survive on some pages."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("id_n"))
    return rewrites.renumbered(d.withColumn("captured", F.when((F.col("doc_id") + F.col("page") + F.col("id_n")) % 4 == 0, F.col("page") * 3 + F.col("id_n") + 57)))


@query(
    """with n as (select doc_id, k, case when (doc_id + k) % 3 = 0 then k + 10 end as own from documents, (values (1), (2), (3), (4), (5), (6)) v(k))
    select doc_id, string_agg('- ' || cast(coalesce((select max(b.k) from n b where b.doc_id = n.doc_id and b.own is not null and b.k <= n.k) + 10 + n.k - (select max(b.k) from n b where b.doc_id = n.doc_id and b.own is not null and b.k <= n.k), n.k) as varchar) || '. A. Smith (1960)', '; ' order by k) as entries from n group by doc_id"""
)
def footnote_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page footnotes as a numbered list; missing numbers go on from the one before."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k"))
    own = F.when((F.col("doc_id") + F.col("k")) % 3 == 0, F.concat((F.col("k") + 10).cast("string"), F.lit(" A. Smith (1960)"))).otherwise("A. Smith (1960)")
    got = references.footnote_references(d.select("doc_id", F.lit(0).alias("page_idx"), F.col("k").cast("double").alias("y0"), own.alias("text")))
    return got.select("doc_id", F.array_join("entries", "; ").alias("entries"))


@query(
    """select doc_id, kind, id, note from (select doc_id, 'table' as kind, cast(doc_id % 3 as varchar) as id, 'new' as note from documents where doc_id % 2 = 0
    union all select doc_id, 'table', cast(k as varchar), 'old' from documents, (values (0), (1)) v(k) where not (doc_id % 2 = 0 and doc_id % 3 = k))"""
)
def upserted_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits replaced by document, kind and id."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("table").alias("kind"))
    old = d.select("doc_id", "kind", F.explode(F.array(F.lit("0"), F.lit("1"))).alias("id"), F.lit("old").alias("note"))
    return edits.upserted(old, d.where("doc_id % 2 = 0").select("doc_id", "kind", (F.col("doc_id") % 3).cast("string").alias("id"), F.lit("new").alias("note")))


@query("select conv_id, cast(min(turn) as bigint) as first_turn, cast(max(turn) as bigint) as last_turn, count(*) as n from (select *, turn - row_number() over (partition by conv_id order by turn) as g from (select conv_id, turn from conversations union all select conv_id, turn + 100000 from conversations)) group by conv_id, g")
def turn_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive turns in real conversations, each of which goes on after a gap."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    kept = turns.unionByName(turns.withColumn("turn", F.col("turn") + 100_000))
    g = F.col("turn") - F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return kept.withColumn("g", g).groupBy("conv_id", "g").agg(F.min("turn").cast("bigint").alias("first_turn"), F.max("turn").cast("bigint").alias("last_turn"), F.count("*").alias("n")).drop("g")


@query("select doc_id, y1 < 0.25 as rotated, cast(y1 as double) as flipped_y0, sparse from (select doc_id, 792.0 - (100 + doc_id % 50) as y1, n_chars / (612.0 * 792.0) < 0.005 as sparse from documents)")
def page_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse pages, rotated boxes, boxes from a bottom-left origin."""
    d = table(spark, sf_dir, "documents")
    b = F.struct(F.lit(10.0).alias("x0"), F.lit(50.0).alias("y0"), F.lit(200.0).alias("x1"), (100 + F.col("doc_id") % 50).cast("double").alias("y1"))
    return d.select("doc_id", geo.rotated(b).alias("rotated"), geo.flipped(b, F.lit(792.0))["y0"].alias("flipped_y0"), geo.sparse(F.col("n_chars"), F.lit(612.0), F.lit(792.0)).alias("sparse"))
