"""Markdown -> markdown passes. All are expressions on one text, so they also run on streams.

Line passes take and give the array of a text's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import REFERENCES_HEADING
from ..functions.text import let
from .references import BRACKETED, HEADING

_LINE_NUMBER = r"^\s*\d{1,4}\s*$"
_FOOTER = r"^.{1,60}?\s+(?:et\s+al|ET\s+AL)\.?\s+\d+\s+of\s+\d+\s*$"
_HEADER_LABEL = r"^\s*\**\s*(?:LETTERS?|ARTICLES?|REVIEWS?|PERSPECTIVES?|NEWS\s*&\s*VIEWS|PROGRESS\s+ARTICLE|COMMENTARY)\s*\**\s*$"
_HEADER_DOI = r"^\s*\**\s*(?:LETTERS?\s+|ARTICLES?\s+)?[A-Z][A-Z &]{3,80}\s+DOI:\s*\S.*$"
#: Phrases of a publisher's download stamp.
STAMPS = (
    r"^\s*(?:https?://)?onlinelibrary\.wiley\.com/",
    r"Wiley\s+Online\s+Library\s+on\s+\[",
    r"See\s+the\s+Terms\s+and\s+Conditions",
    r"wiley\.com/terms-and-conditions",
    r"rules\s+of\s+use;\s+OA\s+articles",
    r"OA\s+articles\s+are\s+governed\s+by\s+the\s+applicable\s+Creative\s+Commons",
)


def _fenced(lines: Column) -> Column:
    """Whether each line stands in a fenced block (the fences too)."""
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<boolean>").alias("out"))
    fence = lambda x: x.rlike(r"^\s*```")
    return F.aggregate(lines, start, lambda s, x: F.struct((s["open"] != fence(x)).alias("open"), F.concat(s["out"], F.array(s["open"] | fence(x))).alias("out")), lambda s: s["out"])


def _without(md: Column, drop, guarded: bool = True) -> Column:
    """A text without the lines for which ``drop`` holds; code blocks and table rows stay if guarded."""
    lines = F.split(md, "\n")
    both = F.arrays_zip(lines.alias("line"), _fenced(lines).alias("code"))
    safe = lambda x: (x["code"] | x["line"].rlike(r"^\s*\|")) if guarded else F.lit(False)
    return F.array_join(F.transform(F.filter(both, lambda x: safe(x) | ~drop(x["line"])), lambda x: x["line"]), "\n")


def strip_line_numbers(md: Column) -> Column:
    return _without(md, lambda x: x.rlike(_LINE_NUMBER), guarded=False)


def strip_running_footers(md: Column) -> Column:
    return _without(md, lambda x: x.rlike(_FOOTER))


def strip_page_headers(md: Column) -> Column:
    item = lambda x: x.rlike(r"^\s*(?:[-*+]\s|\d+[.)]\s)")
    return _without(md, lambda x: (F.length(x) <= 250) & ~item(x) & (x.rlike(_HEADER_LABEL) | x.rlike(_HEADER_DOI)))


def strip_stamps(md: Column) -> Column:
    """Also no more than two blank lines in a row."""
    return F.regexp_replace(_without(md, lambda x: x.rlike("|".join(f"(?:{s})" for s in STAMPS))), r"\n{4,}", "\n\n\n")


def strip_math_labels(md: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(md, r"\\label\{[^}]*\}", ""), r"\\eqref\{([^}]*)\}", "($1)")


def cleaned(md: Column) -> Column:
    """All strippers, in order."""
    for step in (strip_line_numbers, strip_running_footers, strip_page_headers, strip_stamps, strip_math_labels):
        md = step(md)
    return md


_SPAN_LINE = r"^<span id=\"page-\d+-\d+\"></span>\S"


def normal_spans(md: Column) -> Column:
    """Span-anchored references: runs of two or more get bullets, split DOI links join, cross-reference wrappers go."""
    def bulleted(lines: Column) -> Column:
        at = lambda i: F.coalesce(F.get(lines, i), F.lit(""))
        anchored = lambda i: at(i).rlike(_SPAN_LINE)
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.when(anchored(i) & (anchored(i - 1) | anchored(i + 1)), F.concat(F.lit("- "), at(i))).otherwise(at(i))), "\n")

    out = let(F.split(md, "\n"), bulleted)
    joined = F.regexp_replace(out, r"\[https?://(?:dx\.)?doi\.org/\]\([^)]*\)\s*\[(10\.(?:[^\]\\]|\\.)*)\]\((?:[^()\\]|\\.|\([^()]*\))*\)", "<https://doi.org/$1>")
    plain = F.regexp_replace(joined, r"(<https://doi\.org/[^>\\]*)\\([()])", "$1$2")
    plain = F.regexp_replace(plain, r"(<https://doi\.org/[^>\\]*)\\([()])", "$1$2")
    return F.regexp_replace(plain, r"\[([^\]]*)\]\(https?://refhub\.elsevier\.com/(?:[^()]|\([^()]*\))*\)", "$1")


def renumbered(anchors: DataFrame) -> DataFrame:
    """Anchored references ``doc_id, page, id_n, captured`` with ``number``: captured, or else ``id_n`` plus the page's offset.

    A page's offset is that of a captured number on it, else the previous page's plus that page's
    count, else the next page's less its own count; null if no page of the document has one.
    """
    by_page = anchors.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.min(F.col("captured") - F.col("id_n")).alias("offset"))
    order = Window.partitionBy("doc_id").orderBy("page")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    running = by_page.withColumn("sum", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # an offset less the entries before the page stays the same from page to page
    level = F.col("offset") - F.col("sum")
    back = F.first(level, ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ahead = F.last(level, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = running.select("doc_id", "page", (F.coalesce(ahead, back) + F.col("sum")).alias("page_offset"))
    return anchors.join(offsets, ["doc_id", "page"]).select("doc_id", "page", "id_n", "captured", F.coalesce("captured", F.col("id_n") + F.col("page_offset")).alias("number"))


_SUP = r"<sup>(\d+)</sup>"


def consolidated_footnotes(md: Column) -> Column:
    """Lines that begin with ``<sup>N</sup>`` move to one numbered list at the end, in order of N; a later ``<sup>`` on such a line begins another only before a name."""
    text = F.regexp_replace(md, r"<sup>&</sup>lt;sup>(\d+)</sup>", "<sup>$1</sup>")
    lines = F.split(text, "\n")
    is_note = lambda x: x.rlike(rf"^\s*{_SUP}\s*\S")
    notes = F.flatten(F.transform(F.filter(lines, is_note), lambda x: F.split(F.trim(x), rf"\s*(?={_SUP}\s*[*_]*[A-Za-z])")))
    full = F.filter(notes, lambda x: F.trim(x) != "")
    placed = F.transform(full, lambda x, i: F.struct(F.regexp_extract(x, rf"^{_SUP}", 1).cast("int").alias("n"), i.alias("i"), F.trim(F.regexp_replace(x, rf"^{_SUP}", "")).alias("t")))
    listed = F.transform(F.array_sort(placed), lambda p: F.concat(p["n"].cast("string"), F.lit(". "), p["t"]))
    rest = F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~is_note(x)), "\n"), r"\s+$", "")
    return F.when(text.rlike(REFERENCES_HEADING) | (F.size(full) == 0), md).otherwise(F.concat(rest, F.lit(f"\n\n{HEADING}\n\n"), F.array_join(listed, "\n"), F.lit("\n")))


_ALIAS = r"(?i)^(#+)\s*\**\s*(?:references?|bibliography|cited\s+references|notes\s+and\s+references|references\s+(?:and|&)\s+notes|methods?\s+references)\s*\**\s*:?\s*\**\s*$"
_ENTRY = r"^\s*[-*]\s+(?:<span id=\"page-\d+-\d+\"></span>)*\s*\d"


def _sections(lines: Column) -> Column:
    """For each line the depth of the references section it is in, 0 outside."""
    depth = lambda x: F.length(F.regexp_extract(x, r"^(#+)\s", 1))
    start = F.struct(F.lit(0).alias("d"), F.array().cast("array<int>").alias("out"))
    now = lambda s, x: F.when(x.rlike(_ALIAS), depth(x)).when((depth(x) > 0) & (depth(x) <= s["d"]), F.lit(0)).otherwise(s["d"])
    return F.aggregate(lines, start, lambda s, x: F.struct(now(s, x).alias("d"), F.concat(s["out"], F.array(now(s, x))).alias("out")), lambda s: s["out"])


def with_orphan_headings(md: Column) -> Column:
    """A references heading above every run of three or more numbered bullets outside such a section, half of them with a year."""
    def headed(lines: Column, depths: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(lines) - 1)
        orphan = lambda i: F.coalesce((F.get(depths, i) == 0) & F.get(lines, i).rlike(_ENTRY), F.lit(False))
        stop = lambda i: F.coalesce(F.array_min(F.filter(numbers, lambda j: (j > i) & ~orphan(j))), F.size(lines))
        years = lambda i, end: F.size(F.filter(F.slice(lines, i + 1, end - i), lambda x: x.rlike(r"\b(?:18|19|20)\d{2}\b")))
        begins = lambda i: F.when(orphan(i) & ~orphan(i - 1), let(stop(i), lambda end: (end - i >= 3) & (2 * years(i, end) >= end - i))).otherwise(F.lit(False))
        return F.array_join(F.transform(numbers, lambda i: F.when(begins(i), F.concat(F.lit(f"{HEADING}\n\n"), F.get(lines, i))).otherwise(F.get(lines, i))), "\n")

    return let(F.split(md, "\n"), lambda lines: let(_sections(lines), lambda depths: headed(lines, depths)))


def merged_sections(md: Column) -> Column:
    """Two or more references sections as one at the end, bodies in order; other sections stay where they are."""
    lines = F.split(md, "\n")
    both = F.arrays_zip(lines.alias("line"), _sections(lines).alias("d"))
    text = lambda keep: F.array_join(F.transform(F.filter(both, keep), lambda x: x["line"]), "\n")
    rest = F.regexp_replace(text(lambda x: x["d"] == 0), r"\s+$", "")
    body = F.regexp_replace(F.regexp_replace(text(lambda x: (x["d"] > 0) & ~x["line"].rlike(_ALIAS)), r"\n{2,}", "\n"), r"^\s+|\s+$", "")
    return F.when(F.size(F.filter(lines, lambda x: x.rlike(_ALIAS))) >= 2, F.concat(rest, F.lit(f"\n\n{HEADING}\n\n"), body, F.lit("\n"))).otherwise(md)


_CITATION = r"^(?:[-*]\s+)?(?:<span id=\"page-\d+-\d+\"></span>)*\s*(?:(?:\[?\d{1,3}[\].)]?\s*)?[A-Z][\w'’\-]+(?:\s+[A-Z][\w'’\-]+)*,\s|\[?\d{1,3}[\].)]?\s*[A-Z]\.)"
_ADDENDUM = r"^(?:[-*]\s+)?(?:\(Received\b|[A-Z]\. (?:[A-Z]\. )?[A-Z]\w+, .*\b\d{5}\.$)"


def tidy_entries(lines: Column) -> Column:
    """Lines of a references section: continuations join their entry, entries get bullets, addenda follow as paragraphs."""
    full = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    bare = lambda x: F.regexp_replace(x, r"^[-*]\s+", "")
    addenda = F.transform(F.filter(full, lambda x: x.rlike(_ADDENDUM)), bare)
    rest = F.filter(full, lambda x: ~x.rlike(_ADDENDUM))
    joined = F.aggregate(rest, F.array().cast("array<string>"), lambda out, x: F.when((F.size(out) == 0) | x.rlike(_CITATION), F.concat(out, F.array(bare(x)))).otherwise(F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), F.lit(" "), bare(x))))))
    return F.concat(F.transform(joined, lambda x: F.concat(F.lit("- "), x)), F.when(F.size(addenda) > 0, F.concat(F.array(F.lit("")), addenda)).otherwise(F.array().cast("array<string>")))


def aps_heading(md: Column, slug: Column) -> Column:
    """For an APS journal without the heading: one above five or more lines ``[1]``, ``[2]``, ... that rise to the end."""
    def headed(lines: Column) -> Column:
        n = lambda i: F.regexp_extract(F.get(lines, i), BRACKETED, 1).cast("int")
        marks = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(BRACKETED))
        start = lambda found: F.array_max(F.filter(found, lambda i: n(i) == 1))
        rises = lambda run: F.forall(F.sequence(F.lit(1), F.greatest(F.size(run) - 1, F.lit(1))), lambda k: (F.size(run) < 2) | (F.get(run, k) > F.get(run, k - 1)))
        good = lambda run: (F.size(run) >= 5) & rises(run)
        cut = lambda at: F.concat(F.regexp_replace(F.array_join(F.slice(lines, F.lit(1), at), "\n"), r"\s+$", ""), F.lit(f"\n\n{HEADING}\n\n"), F.array_join(F.slice(lines, at + 1, F.size(lines)), "\n"), F.lit("\n"))
        return let(marks, lambda found: let(start(found), lambda at: F.when(let(F.transform(F.filter(found, lambda i: i >= at), n), good), cut(at))))

    wanted = slug.startswith("aps") & ~md.rlike(REFERENCES_HEADING)
    return F.coalesce(F.when(wanted, let(F.split(F.regexp_replace(md, r"\s+$", ""), "\n"), headed)), md)


def with_api_references(docs: DataFrame, scores: DataFrame, fetched: DataFrame) -> DataFrame:
    """``doc_id, md`` with a section of the references a service has, where the own ones are poor, absent or have gaps.

    ``fetched``: ``doc_id, source, entries array`` of bullets. One section for each document at most.
    """
    both = docs.join(scores.select("doc_id", "score", "section_count", "style", "numbered_continuous", "entry_count"), "doc_id", "left").join(fetched, "doc_id", "left")
    gate = (F.col("score") < 0.5) | (F.col("section_count") == 0) | ((F.col("style") == "numbered") & ~F.col("numbered_continuous") & (F.col("entry_count") >= 3))
    ok = gate & (F.size("entries") > 0) & ~F.col("md").rlike(r"(?m)^## References \(from ")
    return both.select("doc_id", F.when(ok, F.concat(F.regexp_replace("md", r"\s+$", ""), F.lit("\n\n## References (from "), "source", F.lit(")\n\n"), F.array_join("entries", "\n"), F.lit("\n"))).otherwise(F.col("md")).alias("md"), F.when(ok, F.size("entries")).otherwise(0).alias("api_refs_appended"))


def resplit(entry: Column, slug: Column) -> Column:
    """Entries that hold several: numbered ones part before `` [N] `` or `` N. ``, author-year ones after ``year.`` before a name."""
    numbered = F.split(entry, r"(?<=[.\])])\s+(?=\[?\d{1,3}[\].]\s+[A-Z])")
    named = F.split(entry, r"(?<=[12]\d{3}[a-z]?[.)])\s+(?=[A-Z][a-z]+,\s+[A-Z]\.)")
    return F.when(F.coalesce(slug, F.lit("")).rlike("^(?:agu|elsevier|copernicus|wiley)"), named).otherwise(numbered)


def bounded_last(entry: Column) -> Column:
    """The last entry without body text that ran into it: cut after its first closing year or page."""
    found = F.regexp_extract(entry, r"(?s)^(.*?(?:\([12]\d{3}[a-z]?\)|\b[12]\d{3}[a-z]?)\.)(?=\s+[A-Z].{200,})", 1)
    return F.when(found != "", found).otherwise(entry)


def rescued(docs: DataFrame, threshold: float = 0.65, ratio: float = 8.0, apply: bool = True) -> DataFrame:
    """Journal repair of reference entries ``doc_id, entries, slug, score, longest_over_median``: only with a known journal, and if the score is low or one entry is much longer than the rest. Without ``apply`` only the verdict is given."""
    unbounded = bounded_last(F.element_at("entries", -1)) != F.element_at("entries", -1)
    needed = F.col("slug").isNotNull() & (F.size("entries") > 0) & ((F.col("score") < threshold) | ((F.col("longest_over_median") > ratio) & unbounded))
    parts = F.flatten(F.transform("entries", lambda e: resplit(e, F.col("slug"))))
    fixed = F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(bounded_last(F.element_at(parts, -1))))
    return docs.select("doc_id", F.coalesce(needed, F.lit(False)).alias("needed"), F.when(needed & F.lit(apply), fixed).otherwise(F.col("entries")).alias("entries"))


def swapped_sections(left: DataFrame, right: DataFrame) -> DataFrame:
    """``doc_id, md`` of the left source with the references section of the right one, where both have the heading; a right section that a top heading follows isn't taken."""
    head = r"(?m)^#{1,3}\s*\**References\**\s*$"
    split = lambda md: F.split(md, head, 2)
    own, other = split(F.col("l.md")), split(F.col("r.md"))
    tail = lambda part: F.regexp_extract(part, r"(?s)^(.*?)(?=\n#{1,3}\s|\z)", 1)
    after = F.substring(own[1], F.length(tail(own[1])) + 1, F.length(own[1]))
    ok = (F.size(own) == 2) & (F.size(other) == 2) & ~other[1].rlike(r"(?m)^#\s")
    return left.alias("l").join(right.alias("r"), F.col("l.doc_id") == F.col("r.doc_id"), "left").select(F.col("l.doc_id").alias("doc_id"), F.when(ok, F.concat(own[0], F.lit(HEADING), tail(other[1]), after)).otherwise(F.col("l.md")).alias("md"), F.coalesce(ok, F.lit(False)).alias("swapped"))


def without_images(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``doc_id, line_no, line`` without the image links (and the anchors before them) whose file name ``gone`` lists."""
    name = F.element_at(F.split(F.regexp_extract("line", r"^\s*(?:<span[^>]*></span>)*!\[[^\]]*\]\(([^)]+)\)\s*$", 1), "/"), -1)
    return docs.withColumn("_name", name).join(gone.select("doc_id", F.col("name").alias("_name")), ["doc_id", "_name"], "left_anti").select("doc_id", "line_no", "line")


def orphan_table_captions(lines: DataFrame, reach: int = 30) -> DataFrame:
    """``doc_id, line_no, table_id``: caption lines without a table, image or sidecar within ``reach`` lines or before the next caption."""
    caption = F.regexp_extract("line", r"^\s*\**\s*Table\s+([A-Z]?\.?\d+|S?[IVXLC]+)\**\s*[.:]\s*\S", 1)
    signal = F.col("line").rlike(r"^\s*\|?(?:\s*:?-{3,}:?\s*\|)+|^\s*!\[Table\s|\[Table\s+\S+\s+[-—]\s+separate\s+markdown\]")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    rows = lines.withColumns({"table_id": F.nullif(caption, F.lit("")), "signal": F.when(signal, F.col("line_no"))})
    rows = rows.withColumns({"next_signal": F.min("signal").over(after), "next_caption": F.min(F.when(F.col("table_id").isNotNull(), F.col("line_no"))).over(after)})
    none = F.col("next_signal").isNull() | (F.col("next_signal") > F.col("line_no") + reach) | (F.col("next_signal") > F.col("next_caption"))
    return rows.where("table_id is not null").where(F.coalesce(none, F.lit(False))).select("doc_id", "line_no", "table_id")


def spliced(lines: DataFrame, inserts: DataFrame) -> DataFrame:
    """``doc_id, md``: lines with rows ``doc_id, after_line, nth, text`` put in after theirs. Order keys, not offsets, place them, so inserts can't move one another."""
    own = lines.select("doc_id", F.struct("line_no", F.lit(0).alias("side"), F.lit(0).alias("nth"), "line").alias("x"))
    new = inserts.select("doc_id", F.struct(F.col("after_line").alias("line_no"), F.lit(1).alias("side"), F.col("nth").cast("int").alias("nth"), F.col("text").alias("line")).alias("x"))
    return own.unionByName(new).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("md"))


