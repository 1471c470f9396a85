"""Links to data repositories, with the section they stand in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import AVAILABILITY, GENERIC_DATAVERSE, REPOSITORIES
from ..functions.text import let

_HEADING = r"^\s*#+\s+"
_SECTION = rf"(?i)^\s*#+\s*\**\s*{AVAILABILITY}\s*\**\s*[:.]?\s*$"
_BOLD = rf"(?i)^\s*\*\*\s*{AVAILABILITY}\s*\**\s*[:.]?\s*\*\*\s*$"


def line_sections(lines: Column) -> Column:
    """For each line of a document, the title of the availability section it is in, else null.

    A section begins at its heading or bold line and ends at the next heading of any depth.
    """
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)
    at = lambda i: F.get(lines, i)
    starting = F.filter(numbers, lambda i: at(i).rlike(_SECTION) | at(i).rlike(_BOLD))
    heading = F.filter(numbers, lambda i: at(i).rlike(_HEADING))
    title = lambda i: F.trim(F.regexp_replace(F.regexp_replace(F.trim(at(i)), r"^#+", ""), r"^[\s*]+|[\s*]+$", ""))

    def placed(starts: Column, headings: Column) -> Column:
        begun = lambda i: F.coalesce(F.array_max(F.filter(headings, lambda h: h <= i)), F.lit(-1))
        within = lambda i: let(begun(i), lambda b: F.array_min(F.filter(starts, lambda s: (s <= i) & (s >= b))))
        return F.transform(numbers, lambda i: let(within(i), lambda s: F.when(s.isNotNull(), title(s))))

    none = F.transform(numbers, lambda i: F.lit(None).cast("string"))
    return let(starting, lambda starts: F.when(F.size(starts) > 0, let(heading, lambda headings: placed(starts, headings))).otherwise(none))


def _made(template: str, record: Column) -> Column:
    before, after = template.split("{id}")
    return F.concat(F.lit(before), record, F.lit(after))


def _hits(pattern: str, rule: int, form: int, name: str, doi_form: str, url_form: str) -> Column:
    made = lambda x, i: F.struct(F.lit(rule).alias("rule"), F.lit(form).alias("form"), i.alias("nth"), F.lit(name).alias("repository"), _made(url_form, x).alias("url"), _made(doi_form, x).alias("doi"), F.substring_index(x, "/", -1).alias("record_id"))
    return F.transform(F.regexp_extract_all("line", F.lit(pattern), 1), made)


def mentions(docs: DataFrame, md: str = "md") -> DataFrame:
    """Every mention of a repository: ``doc_id, rule, form, line_no, nth, repository, url, doi, record_id, section``.

    Lines are looked at inside each row, so nothing moves between machines.
    """
    held = docs.select("doc_id", F.split(F.coalesce(F.col(md), F.lit("")), "\n").alias("lines")).withColumn("sections", line_sections(F.col("lines")))
    likely = held.select("doc_id", F.posexplode(F.arrays_zip("lines", "sections")).alias("line_no", "l"))
    rows = likely.select("doc_id", "line_no", F.col("l.lines").alias("line"), F.col("l.sections").alias("section")).where(F.col("line").rlike(r"10\.\d{4}|://|\.(?:org|edu|gov|com|io|de|ca)/"))
    found = []
    for number, (name, doi, url, doi_form, url_form) in enumerate(REPOSITORIES):
        for form, pattern in enumerate((doi, url)):
            found.append(_hits(pattern, number, form, name, doi_form, url_form))
    address = lambda x: F.regexp_replace(x, r"[.,;)>]+$", "")
    host = lambda x: F.concat(F.lower(F.substring_index(x, "/dataset.xhtml", 1)), F.lit("/dataset.xhtml?persistentId="), F.substring_index(address(x), "persistentId=", -1))
    own = F.filter(F.regexp_extract_all("line", F.lit(GENERIC_DATAVERSE), 1), lambda x: ~x.rlike(r"(?i)dataverse\.harvard\.edu|borealisdata\.ca"))
    found.append(F.transform(own, lambda x, i: F.struct(F.lit(len(REPOSITORIES)).alias("rule"), F.lit(1).alias("form"), i.alias("nth"), F.lit("dataverse").alias("repository"), F.concat(F.lit("https://"), host(x)).alias("url"), F.substring_index(address(x), "doi:", -1).alias("doi"), F.lit(None).cast("string").alias("record_id"))))
    return rows.select("doc_id", "line_no", "section", F.explode(F.concat(*found)).alias("m")).select("doc_id", "m.rule", "m.form", "line_no", "m.nth", "m.repository", "m.url", "m.doi", "m.record_id", "section")


def data_links(docs: DataFrame, md: str = "md") -> DataFrame:
    """One row a document and deposit: the first mention; its section is the first that any mention has, and makes it of high confidence."""
    order = F.struct("rule", "form", "line_no", "nth")
    key = F.lower(F.coalesce("doi", "url"))
    by = mentions(docs, md).groupBy("doc_id", key.alias("key")).agg(F.min_by(F.struct("repository", "url", "doi", "record_id"), order).alias("first"), F.min_by("section", F.when(F.col("section").isNotNull(), order)).alias("section"))
    return by.select("doc_id", "first.*", "section", F.when(F.col("section").isNotNull(), "high").otherwise("medium").alias("confidence"))


def parsed_summary(responses: DataFrame) -> DataFrame:
    """Pre-fetched repository responses ``(repository, key, status, body)`` as title, description, licence, files (at most 50) and fetch status."""
    from ..functions.text import blank_to_null, strip_html

    j = lambda *paths: F.coalesce(*(blank_to_null(F.get_json_object("body", p)) for p in paths))
    files = F.from_json(F.coalesce(F.get_json_object("body", "$.files"), F.lit("[]")), "array<struct<key:string,name:string,filename:string,size:bigint,type:string,format:string>>")
    named = F.transform(F.slice(files, 1, 50), lambda f: F.struct(F.coalesce(f["key"], f["name"], f["filename"]).alias("name"), f["size"].alias("size"), F.coalesce(f["type"], f["format"]).alias("format")))
    unsupported = F.col("repository").isin("ess-dive", "mendeley-data", "icpsr")
    bad = F.try_parse_json("body").isNull()
    status = F.when(unsupported, "not_implemented").when(F.col("status").isNull(), "network_error").when(F.col("status") == 404, "not_found").when(F.col("status") >= 400, "http_error").when(bad, "parse_error").otherwise("ok")
    ok = status == "ok"
    return responses.select("repository", "key", F.when(ok, j("$.metadata.title", "$.title", "$.data.attributes.title")).alias("title"), F.when(ok, strip_html(j("$.metadata.description", "$.description", "$.abstract", "$.data.attributes.description"))).alias("description"), F.when(ok, j("$.metadata.license.id", "$.license.name", "$.license")).alias("license"), F.when(ok, F.coalesce(named, F.array().cast("array<struct<name:string,size:bigint,format:string>>"))).alias("files"), status.alias("fetch_status"))
