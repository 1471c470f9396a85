"""Article metadata from pre-fetched responses of several services, in a fixed order with guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import journal, licence, licence_home, safety
from ..functions.text import blank_to_null, normal_title

YEAR_RULE = 95
OVERRIDABLE = ("pmc-author-manuscript", "osti-public-access", "green-oa-no-license")


def title_of(spans: DataFrame, info: DataFrame) -> DataFrame:
    """``(doc_id, title)``: a usable title from the file's properties, else the first page's line of the largest type.

    ``spans``: ``doc_id, line_no, text, size`` of page 1; ``info``: ``doc_id, title``. Lines of 15 to 300
    characters that aren't all capitals count.
    """
    line = F.trim("text")
    fits = (F.length(line).between(15, 300)) & ~((F.upper(line) == line) & (F.lower(line) != line))
    big = spans.where(fits).groupBy("doc_id").agg(F.max_by(line, F.struct("size", line)).alias("largest"))
    own = F.trim("title")
    usable = F.when((F.length(own) > 15) & ~F.lower(own).startswith("untitled"), own)
    return info.join(big, "doc_id", "left").select("doc_id", F.coalesce(usable, "largest").alias("title"))


def crossref_year(work: Column) -> Column:
    """Publication year of a work's JSON, from the first of four keys that has one."""
    return F.coalesce(*(F.get_json_object(work, f"$['{k}']['date-parts'][0][0]").try_cast("int") for k in ("published", "issued", "published-print", "published-online")))


def matched_by_title(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Search results ``(query_id, pos, title, score, doi)``: the first of the top five whose title is the query's, else the top one if its score is 50 or more."""
    exact = normal_title(F.col("i.title")) == normal_title(F.col("q.title"))
    both = queries.alias("q").join(items.where("pos <= 5").alias("i"), "query_id")
    ok = both.where(exact | ((F.col("i.pos") == 1) & (F.col("i.score") >= 50)))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(exact.desc(), "i.pos"))
    return ok.withColumn("rank", best).where("rank = 1").select("query_id", F.col("i.doi").alias("doi"), F.when(exact, "exact").otherwise("score").alias("by"))


def osti_match(records: DataFrame) -> DataFrame:
    """Records ``(doi, pos, record_doi, osti_id, links array<struct<rel,url>>)``: the first whose DOI is the query's, with its first full text."""
    fulltext = F.try_element_at(F.filter("links", lambda x: (F.lower(x["rel"]) == "fulltext") & x["url"].isNotNull()), F.lit(1))["url"]
    mine = records.where(F.lower(F.trim("record_doi")) == F.lower("doi"))
    return mine.groupBy("doi").agg(F.min_by(F.struct("osti_id", fulltext.alias("fulltext_url")), "pos").alias("r")).select("doi", "r.*")


def resolved(articles: DataFrame, openalex: DataFrame, unpaywall: DataFrame, europepmc: DataFrame, osti: DataFrame, arxiv: DataFrame, as_of_year: int, cache: DataFrame | None = None) -> DataFrame:
    """Licence, open-access state and safety tier of each article.

    ``articles``: ``doc_id, doi, arxiv_id, confidence``. Responses by ``doi`` (arXiv by ``arxiv_id``):
    OpenAlex ``license, oa_status, oa_url, year``; Unpaywall ``license, is_oa, pdf_url``; Europe PMC
    ``license, pmcid, has_pdf, is_open, year``; OSTI ``osti_id, fulltext_url``; arXiv ``license``. A
    ``cache`` of ``doi, license, oa_status, oa_pdf_url, year, resolved_via`` goes before all of them.
    Each later source is asked only for what is still missing. Repeated responses of a source count
    once: the least of them.
    """

    def named(df: DataFrame, p: str, key: str = "doi") -> DataFrame:
        """One row a key: of several responses the least."""
        rest = [c for c in df.columns if c != key]
        one = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("one"))
        return one.select(F.col(key).alias(f"{p}_key"), *(F.col(f"one.{c}").alias(f"{p}_{c}") for c in rest))

    d = articles
    if cache is not None:
        d = d.join(named(cache, "ca"), F.col("doi") == F.col("ca_key"), "left")
    else:
        d = d.withColumns({"ca_key": F.lit(None).cast("string"), **{f"ca_{c}": F.lit(None).cast("string") for c in ("license", "oa_status", "oa_pdf_url", "resolved_via")}, "ca_year": F.lit(None).cast("int")})
    for df, p in ((openalex, "ox"), (unpaywall, "up"), (europepmc, "ep"), (osti, "os")):
        d = d.join(named(df, p), F.col("doi") == F.col(f"{p}_key"), "left")
    d = d.join(named(arxiv, "ax", "arxiv_id"), F.col("arxiv_id") == F.col("ax_key"), "left")
    has = lambda p: F.col(f"{p}_key").isNotNull()
    lic = lambda p: licence(F.col(f"{p}_license"))
    d = d.withColumns({"year": F.coalesce("ca_year", "ox_year"), "license": F.coalesce(F.col("ca_license"), lic("ox")), "url": F.coalesce(blank_to_null(F.col("ox_oa_url")), F.col("ca_oa_pdf_url")), "state": F.when(has("ox"), F.coalesce(blank_to_null(F.col("ox_oa_status")), F.lit("unknown"))).otherwise(F.coalesce("ca_oa_status", F.lit("unknown")))})
    d = d.withColumn("via", F.coalesce("ca_resolved_via", F.when(F.col("ca_license").isNull() & F.col("license").isNotNull(), "openalex")))
    ask = has("up") & (F.col("license").isNull() | F.col("url").isNull())
    d = d.withColumns({"state": F.when(ask & (F.col("state") == "unknown"), F.when(F.col("up_is_oa"), "gold").otherwise("closed")).otherwise(F.col("state")), "url": F.coalesce("url", F.when(ask, blank_to_null(F.col("up_pdf_url")))), "via": F.coalesce("via", F.when(ask & F.col("license").isNull() & lic("up").isNotNull(), "unpaywall")), "license": F.coalesce("license", F.when(ask, lic("up")))})
    ask = has("ep") & ((F.col("license").isNull() & F.col("state").isin("unknown", "closed", "green")) | ((F.col("state") == "green") & (F.col("url").isNull() | F.col("url").contains("ncbi.nlm.nih.gov/pmc"))))
    pdf = ask & F.col("ep_pmcid").isNotNull() & (F.col("ep_has_pdf") == "Y")
    own = F.coalesce(F.when(ask, lic("ep")), F.when(pdf & F.coalesce(F.col("ep_is_open") != "Y", F.lit(True)), "pmc-author-manuscript"))
    d = d.withColumns({"year": F.coalesce("year", F.when(ask, F.col("ep_year"))), "url": F.when(pdf, F.concat(F.lit("https://europepmc.org/articles/"), "ep_pmcid", F.lit("?pdf=render"))).otherwise(F.col("url")), "via": F.coalesce("via", F.when(F.col("license").isNull() & own.isNotNull(), "europepmc")), "license": F.coalesce("license", own)})
    ask = has("os") & (F.col("license").isNull() | F.col("url").isNull())
    full = ask & F.col("url").isNull() & F.col("os_fulltext_url").isNotNull()
    d = d.withColumns({"state": F.when(full & F.col("state").isin("unknown", "closed"), "green").otherwise(F.col("state")), "url": F.when(full, F.col("os_fulltext_url")).otherwise(F.col("url")), "via": F.coalesce("via", F.when(ask & F.col("license").isNull(), "osti")), "license": F.coalesce("license", F.when(ask, "osti-public-access"))})
    d = d.withColumns({"via": F.coalesce("via", F.when(F.col("license").isNull() & lic("ax").isNotNull(), "arxiv")), "license": F.coalesce("license", lic("ax"))})
    fallback = F.col("license").isNull() & F.col("url").isNotNull() & F.col("state").isin("green", "bronze", "gold", "hybrid")
    d = d.withColumns({"via": F.coalesce("via", F.when(fallback, "oa-url-default")), "license": F.when(fallback, "green-oa-no-license").otherwise(F.col("license"))})
    old = (F.col("license").isNull() | F.col("license").isin(*OVERRIDABLE)) & (F.col("year") + YEAR_RULE < as_of_year)
    d = d.withColumns({"via": F.when(old, "us-95-year-rule").otherwise(F.col("via")), "license": F.when(old, "public-domain-us").otherwise(F.col("license"))})
    found = F.when(F.col("confidence") == "medium", "medium").when(F.col("license").isNotNull(), "high").otherwise(F.col("confidence"))
    return d.select("doc_id", "doi", "arxiv_id", journal(F.col("doi")).alias("journal_slug"), "year", "license", licence_home(F.col("license")).alias("license_url"), F.coalesce(safety(F.col("license")), F.lit("false")).alias("safe_to_distribute"), F.col("state").alias("oa_status"), F.col("url").alias("oa_pdf_url"), F.col("via").alias("resolved_via"), found.alias("confidence"))


def ordered_references(ids: DataFrame, works: DataFrame) -> DataFrame:
    """``(doc_id, ids array)`` resolved against works ``(id, entry)`` in list order; misses are dropped."""
    rows = ids.select("doc_id", F.posexplode("ids").alias("pos", "id"))
    return rows.join(works, "id").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]).alias("entries"))


def crossref_bullet(entry: Column, number: Column) -> Column:
    """A deposited reference as a markdown bullet, from its own text or else from its fields."""
    g = lambda name: blank_to_null(F.get_json_object(entry, f"$['{name}']"))
    around = lambda before, value, after="": F.when(value.isNotNull(), F.concat(F.lit(before), value, F.lit(after)))
    doi = g("DOI")
    parts = F.array_compact(F.array(g("author"), around("(", g("year"), ")"), F.coalesce(g("article-title"), g("volume-title")), around("*", g("journal-title"), "*"), around("vol. ", g("volume")), around("p. ", g("first-page")), F.when(doi.isNotNull(), F.concat(F.lit("[doi:"), doi, F.lit("](https://doi.org/"), doi, F.lit(")")))))
    text = F.coalesce(F.trim(F.regexp_replace(g("unstructured"), r"\s+", " ")), F.when(F.size(parts) > 0, F.concat(F.array_join(parts, ", "), F.lit("."))), F.lit("(incomplete reference)"))
    return F.concat(F.lit("- "), number.cast("string"), F.lit(". "), text)


def openalex_bullet(entry: Column, number: Column) -> Column:
    """A resolved work as a markdown bullet; at most six authors are named."""
    authors = F.from_json(F.get_json_object(entry, "$.authorships"), "array<struct<author:struct<display_name:string>>>")
    names = F.filter(F.transform(F.slice(authors, 1, 6), lambda a: a["author"]["display_name"]), lambda n: n.isNotNull())
    who = F.when(F.size(names) > 0, F.concat(F.array_join(names, ", "), F.when(F.size(authors) > F.size(names), ", et al.").otherwise("")))
    g = lambda path: blank_to_null(F.get_json_object(entry, path))
    venue = F.coalesce(g("$.host_venue.display_name"), g("$.primary_location.source.display_name"))
    doi = g("$.doi")
    parts = F.array_compact(F.array(who, F.when(g("$.publication_year").isNotNull(), F.concat(F.lit("("), g("$.publication_year"), F.lit(")"))), g("$.display_name"), F.when(venue.isNotNull(), F.concat(F.lit("*"), venue, F.lit("*"))), F.when(doi.isNotNull(), F.concat(F.lit("[doi:"), F.replace(doi, F.lit("https://doi.org/"), F.lit("")), F.lit("]("), doi, F.lit(")")))))
    return F.concat(F.lit("- "), number.cast("string"), F.lit(". "), F.when(F.size(parts) > 0, F.concat(F.array_join(parts, ", "), F.lit("."))).otherwise("(incomplete reference)"))
