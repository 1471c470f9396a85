"""Reference lists: detection, repair, scoring.

Lists are found in the lines of each text with array functions, so no text moves between machines.
Offsets are 0-based character offsets of line starts; a line end is one character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import REFERENCES_HEADING
from ..functions.text import all_matches, let

#: How entries of each style begin, their years, and the heading that is written.
NUMBERED = r"^[ \t]*(\d{1,3})[.)]\s+\S"
BRACKETED = r"^[ \t]*\[(\d{1,3})\]\s+\S"
FOOTNOTE = r"^(\d{1,3})([A-Z]\.\s)"
AUTHOR_YEAR = r"^[A-Z][A-Za-z\-.,& ]{1,120}(?:\([12]\d{3}[a-z]?\)|,\s+[12]\d{3}[a-z]?[.,])"
YEAR = r"\b(?:19|20)\d{2}\b"
HEADING = "## References"


def line_table(md: Column) -> Column:
    """``array<struct<off, line>>``: each line with its offset."""
    start = F.struct(F.lit(0).alias("off"), F.array().cast("array<struct<off:int,line:string>>").alias("out"))
    step = lambda s, x: F.struct((s["off"] + F.length(x) + 1).alias("off"), F.concat(s["out"], F.array(F.struct(s["off"].alias("off"), x.alias("line")))).alias("out"))
    return F.aggregate(F.split(md, "\n"), start, step, lambda s: s["out"])


def marked(table: Column, pattern: str, end: bool = False) -> Column:
    """``array<struct<off, last, n>>`` of the lines that match: offset, end of the match, number."""
    hits = F.filter(table, lambda x: x["line"].rlike(pattern))
    return F.transform(hits, lambda x: F.struct(x["off"].alias("off"), (x["off"] + F.length(F.regexp_extract(x["line"], pattern, 0))).alias("last"), (F.lit(0) if end else F.regexp_extract(x["line"], pattern, 1).cast("int")).alias("n")))


def last_run(found: Column, gap: int) -> Column:
    """``struct<off, n>`` of the last run of matches at most ``gap`` characters apart, null if it has fewer than five."""
    zero = F.struct(F.lit(-1).alias("off"), F.lit(0).alias("n"), F.lit(-1).alias("last"))
    near = lambda s, x: (s["n"] > 0) & (x["off"] - s["last"] <= gap)
    step = lambda s, x: F.struct(F.when(near(s, x), s["off"]).otherwise(x["off"]).alias("off"), F.when(near(s, x), s["n"] + 1).otherwise(1).alias("n"), x["last"].alias("last"))
    return F.aggregate(found, zero, step, lambda s: F.when(s["n"] >= 5, F.struct(s["off"].alias("off"), s["n"].alias("n"))))


def list_start(md: Column) -> Column:
    """``struct<style, off>`` of a trailing reference list without a heading, else null.

    In order: footnote, bracketed and numbered lists with five entries in the last 30 % (one of them
    numbered 1 to 3), author-year lists with a run of ten in the last 25 %.
    """
    return let(line_table(md), lambda table: _start(table, F.length(md)))


def _start(table: Column, size: Column) -> Column:
    tail = lambda found, share: F.filter(found, lambda x: x["off"] >= F.floor(size * share))
    offs = lambda found: F.array_min(F.transform(found, lambda x: x["off"]))

    def first_note(notes: Column) -> Column:
        late = F.filter(notes, lambda x: x["off"] >= F.floor(size / 2))
        at = lambda found: let(F.array_min(F.transform(found, lambda x: x["n"])), lambda least: F.when(least <= 3, offs(F.filter(found, lambda x: x["n"] == least))))
        return F.when(F.size(tail(notes, 0.7)) >= 5, let(late, at))

    low = lambda pattern: let(tail(marked(table, pattern), 0.7), lambda t: F.when(F.size(t) >= 5, offs(F.filter(t, lambda x: x["n"].isin(1, 2, 3)))))
    by_year = let(last_run(tail(marked(table, AUTHOR_YEAR, end=True), 0.75), 400), lambda run: F.when(run["n"] >= 10, run["off"]))
    forms = [("footnote", let(marked(table, FOOTNOTE), first_note)), ("bracketed", low(BRACKETED)), ("numbered", low(NUMBERED)), ("author-year", by_year)]
    named = lambda style, off: let(off, lambda x: F.when(x.isNotNull(), F.struct(F.lit(style).alias("style"), x.alias("off"))))
    return F.coalesce(*(named(style, off) for style, off in forms))


def with_heading(md: Column) -> Column:
    """The text with a references heading before its trailing list; footnote entries become bullets. Running it again changes nothing."""
    return _headed(md, list_start(md))


def _headed(md: Column, found: Column) -> Column:
    bullets = lambda text: F.regexp_replace(text, f"(?md){FOOTNOTE}", r"- $1. $2")
    head = F.regexp_replace(F.substring(md, F.lit(1), found["off"]), r"\s+$", "")
    tail = F.substring(md, found["off"] + 1, F.length(md))
    joined = F.concat(head, F.lit(f"\n\n{HEADING}\n\n"), F.when(found["style"] == "footnote", bullets(tail)).otherwise(tail))
    return F.when(md.isNull() | (md == ""), md).when(md.rlike(REFERENCES_HEADING), bullets(md)).when(found.isNotNull(), joined).otherwise(md)


def headed(docs: DataFrame, md: str = "md") -> DataFrame:
    """``docs`` with ``with_heading`` applied; lines and the list's start are columns of their own, so each is computed once."""
    rows = docs.withColumn("_lines", line_table(F.col(md))).withColumn("_found", _start(F.col("_lines"), F.length(md)))
    return rows.withColumn(md, _headed(F.col(md), F.col("_found"))).drop("_lines", "_found")


def footnote_references(notes: DataFrame) -> DataFrame:
    """Page footnotes ``doc_id, page_idx, y0, text`` that are references, as ``doc_id, entries array``.

    Notes with a year that aren't marked by a star or a DOI count, five at least; joined ones are
    parted; a missing number is the one before plus one.
    """
    t = F.trim("text")
    usable = notes.where(t.rlike(YEAR) & ~t.startswith("*") & ~F.lower(t).contains("doi.org") & ~F.lower(t).startswith("doi:"))
    enough = usable.withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).where("n >= 5")
    parts = enough.select("doc_id", "page_idx", "y0", F.posexplode(F.split(t, r"(?<=\.)\s+(?=\d{1,3}\s+[A-Z]\.\s)")).alias("part", "entry"))
    rows = parts.select("doc_id", "page_idx", "y0", "part", F.trim("entry").alias("entry")).where("entry <> ''")
    order = Window.partitionBy("doc_id").orderBy("page_idx", "y0", "part", "entry")
    own = F.regexp_extract("entry", r"(?s)^(\d{1,3})\s+(.+)$", 1).try_cast("int")
    numbered = rows.withColumns({"own": own, "row": F.row_number().over(order)})
    base = F.last("own", ignorenulls=True).over(order)
    base_row = F.last(F.when(F.col("own").isNotNull(), F.col("row")), ignorenulls=True).over(order)
    n = F.coalesce(base + F.col("row") - base_row, F.col("row"))
    body = F.when(F.col("own").isNotNull(), F.regexp_extract("entry", r"(?s)^(\d{1,3})\s+(.+)$", 2)).otherwise(F.col("entry"))
    bullets = numbered.select("doc_id", "row", F.concat(F.lit("- "), n.cast("string"), F.lit(". "), body).alias("bullet"))
    return bullets.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "bullet"))), lambda x: x["bullet"]).alias("entries")).where(F.size("entries") >= 5)


def with_footnote_references(docs: DataFrame, notes: DataFrame, scores: DataFrame) -> DataFrame:
    """Texts ``doc_id, md`` whose references are poor (score below 0.4, under three entries, none from a service, no heading) get those of their page footnotes."""
    got = footnote_references(notes)
    both = docs.join(scores.select("doc_id", "score", "entry_count", "api_refs_appended"), "doc_id", "left").join(got, "doc_id", "left")
    poor = F.col("entries").isNotNull() & (F.col("score") < 0.4) & (F.col("entry_count") < 3) & (F.coalesce("api_refs_appended", F.lit(0)) == 0) & ~F.col("md").rlike(REFERENCES_HEADING)
    appended = F.concat(F.regexp_replace("md", r"\s+$", ""), F.lit(f"\n\n{HEADING}\n\n"), F.array_join("entries", "\n"), F.lit("\n"))
    return both.select("doc_id", F.when(poor, appended).otherwise(F.col("md")).alias("md"), F.when(poor, F.concat(F.lit("footnote-refs:"), F.size("entries").cast("string"))).alias("rescue_applied"))


def section(md: Column) -> Column:
    """``struct<count, body>``: number of references headings and the text after the last; without a heading a trailing cluster of bracketed entries; body null if neither."""
    def parts(lines: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(lines) - 1)
        heads = F.filter(numbers, lambda i: F.get(lines, i).rlike(REFERENCES_HEADING))
        stop = lambda last: F.coalesce(F.array_min(F.filter(numbers, lambda i: (i > last) & F.get(lines, i).rlike(r"^#{1,3}\s"))), F.size(lines))
        body = lambda last: F.array_join(F.slice(lines, last + 2, F.greatest(stop(last) - last - 1, F.lit(0))), "\n")
        brackets = F.filter(numbers, lambda i: F.get(lines, i).rlike(BRACKETED))
        cluster = lambda b: F.when(F.size(b) >= 5, F.array_join(F.slice(lines, F.array_min(b) + 1, F.size(lines)), "\n"))
        return let(heads, lambda h: F.struct(F.size(h).alias("count"), F.when(F.size(h) > 0, let(F.array_max(h), body)).otherwise(let(brackets, cluster)).alias("body")))

    return let(F.split(md, "\n"), parts)


def style_of(body: Column) -> Column:
    """By which marker most lines begin: numbered, bracketed, footnote, author-year, bulleted, or none."""
    lines = F.split(F.coalesce(body, F.lit("")), "\n")
    count = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern)))
    kinds = [("bracketed", BRACKETED), ("numbered", rf"^[ \t]*(?:[-*]\s+)?\d{{1,3}}[.)]\s+\S|{NUMBERED}"), ("footnote", FOOTNOTE), ("author-year", rf"^[ \t]*(?:[-*]\s+)?{AUTHOR_YEAR[1:]}"), ("bulleted", r"^[ \t]*[-*]\s+\S")]
    best = F.array_max(F.array(*(F.struct(count(p).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("style")) for k, (name, p) in enumerate(kinds))))
    return F.when(best["n"] > 0, best["style"]).otherwise("none")


def entries(body: Column) -> Column:
    """Entries of a reference list; lines without a marker go on with the entry before."""
    marker = r"^[ \t]*(?:[-*]\s+)?(?:\[\d{1,3}\]|\d{1,3}[.)]|\d{1,3}(?=[A-Z]\.\s))\s*\S|^[ \t]*[-*]\s+\S"
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    begins = lambda x: x.rlike(marker) | x.rlike(AUTHOR_YEAR)
    joined = lambda out, x: F.when((F.size(out) == 0) | begins(x), F.concat(out, F.array(F.trim(x)))).otherwise(F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), F.lit(" "), F.trim(x)))))
    return F.aggregate(lines, F.array().cast("array<string>"), joined)


def numbers(found: Column) -> Column:
    """Leading numbers of entries, those that have one."""
    return F.filter(F.transform(found, lambda e: F.regexp_extract(e, r"^(?:[-*]\s+)?\[?(\d{1,3})[\].)]?", 1).try_cast("int")), lambda n: n.isNotNull())


def missing_numbers(found: Column, most: int = 5) -> Column:
    """Numbers left out between the least and the greatest; none if more than ``most`` are."""
    n = numbers(found)
    gaps = F.array_except(F.sequence(F.array_min(n), F.array_max(n)), n)
    return F.when((F.size(n) > 0) & (F.size(gaps) <= most), gaps).otherwise(F.array().cast("array<int>"))


def scored(docs: DataFrame, md: str = "md") -> DataFrame:
    """Reference score of each text and what it is made of.

    0.20 for a heading, 0.20 for five entries, 0.35 for years, 0.15 if no entry is over five times
    the median length, 0.10 if the last entry is bounded; at most 0.5 below three entries, 0 without.
    """
    d = docs.withColumn("_s", section(F.coalesce(F.col(md), F.lit("")))).withColumn("_e", entries(F.col("_s.body")))
    d = d.withColumns({"_l": F.array_sort(F.transform("_e", F.length)), "_n": numbers(F.col("_e")), "_y": F.size(F.filter("_e", lambda e: e.rlike(YEAR)))})
    n, mid = F.size("_e"), F.floor((F.size("_e") - 1) / 2).cast("int")
    d = d.withColumn("_m", (F.get("_l", mid) + F.get("_l", F.floor(n / 2).cast("int"))) / 2)
    ratio = F.when(n > 0, F.round(F.array_max("_l") / F.greatest(F.col("_m"), F.lit(1.0)), 4))
    year = F.when(n > 0, F.col("_y") / n).otherwise(0.0)
    bounded = F.length(F.try_element_at("_e", F.lit(-1))) <= 3 * F.greatest(F.col("_m"), F.lit(100.0))
    whole = F.when(F.col("_s.count") > 0, 0.2).otherwise(0.0) + 0.2 * F.least(F.lit(1.0), n / 5) + 0.35 * year + F.when(ratio <= 5, 0.15).otherwise(0.0) + F.when(bounded, 0.1).otherwise(0.0)
    score = F.when(n == 0, 0.0).when(n < 3, F.least(whole, F.lit(0.5))).otherwise(whole)
    rises = let(F.col("_n"), lambda m: F.forall(F.sequence(F.lit(1), F.greatest(F.size(m) - 1, F.lit(1))), lambda i: (F.size(m) < 2) | (F.get(m, i) == F.get(m, i - 1) + 1)))
    return d.withColumns({"score": F.round(score, 4), "style": style_of(F.col("_s.body")), "entry_count": n, "section_count": F.col("_s.count"), "numbered_continuous": (F.size("_n") > 0) & rises, "year_hit_ratio": F.round(year, 4), "longest_over_median": ratio}).drop("_s", "_e", "_l", "_n", "_y", "_m")


def preserved(before: Column, after: Column, allowed: tuple[str, ...] = ("references", "notes")) -> Column:
    """Whether every word of four or more letters after a rewrite was there before it."""
    words = lambda t: F.array_distinct(F.transform(all_matches(t, r"([A-Za-z]{4,})"), F.lower))
    return F.size(F.array_except(words(after), F.array_union(words(before), F.array(*(F.lit(w) for w in allowed))))) == 0
