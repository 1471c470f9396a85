"""Text functions on columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often and however deep ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def cascade(value: Column, rules: list[tuple[str, object]], otherwise=None) -> Column:
    """The result of the first rule whose pattern the value matches."""
    out = None
    for pattern, result in rules:
        then = result if isinstance(result, Column) else F.lit(result)
        out = F.when(value.rlike(pattern), then) if out is None else out.when(value.rlike(pattern), then)
    return out.otherwise(otherwise) if otherwise is not None else out


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def join_lines(lines: Column) -> Column:
    """Lines of spans ``array<struct<spans:array<struct<type,content>>>>`` as flowing text.

    Spans and lines are joined by a space, formulas get their dollars, and a hyphen at a line's
    end goes if the next line begins in lower case. Null or empty lines give an empty text.
    """
    content = lambda s: (
        F.when(s["type"] == "interline_equation", F.concat(F.lit("$$"), s["content"], F.lit("$$"))).when(s["type"] == "inline_equation", F.concat(F.lit("$"), s["content"], F.lit("$"))).otherwise(s["content"])
    )
    full = lambda s: F.coalesce(s["content"], F.lit("")) != ""
    pieces = F.filter(F.transform(F.coalesce(lines, F.array()), lambda x: F.array_join(F.transform(F.filter(F.coalesce(x["spans"], F.array()), full), content), " ")), lambda x: x != "")
    glue = lambda out, x: (
        F.when(out == "", x).when(out.endswith("-") & x.rlike(r"^\p{Ll}"), F.concat(F.substring(out, F.lit(1), F.length(out) - 1), x)).otherwise(F.concat(out, F.lit(" "), x))
    )
    return F.trim(F.aggregate(pieces, F.lit(""), glue))


def strip_html(text: Column, most: int = 600) -> Column:
    """Text without tags, white space squeezed, cut at ``most`` characters with an ellipsis."""
    plain = squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " "))
    return F.when(F.length(plain) > most, F.concat(F.rtrim(F.substring(plain, 1, most)), F.lit("..."))).otherwise(plain)


def alt_text(text: Column) -> Column:
    return F.translate(squeeze(text), "[]", "()")


def equation_tags(html: Column) -> Column:
    """``<eq>x</eq>`` as inline math."""
    return F.regexp_replace(html, r"(?s)<eq>(.*?)</eq>", r"\$$1\$")


def strip_chart_details(md: Column) -> Column:
    return F.regexp_replace(md, r"(?s)<details>\s*<summary>line</summary>.*?</details>", "")


def heading_prefix(level: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.when(level.between(1, 6), level).otherwise(2).cast("int")), F.lit(" "))


def file_id(value: Column) -> Column:
    return F.replace(blank_to_null(F.trim(value)), F.lit("."), F.lit("_"))


def figure_file(figure: Column, letter: Column, page_idx: Column, ext: Column) -> Column:
    page = F.when(page_idx.isNull(), "").otherwise(F.concat(F.lit("_p"), (page_idx + 1).cast("string")))
    return F.concat(F.lit("figure_"), F.coalesce(file_id(figure), figure), F.coalesce(letter, F.lit("")), page, ext)


def sidecar_file(prefix: Column, table: Column, page_idx: Column, number: Column) -> Column:
    place = F.when(page_idx.isNull(), number.cast("string")).otherwise(F.concat(F.lit("p"), (page_idx + 1).cast("string"), F.lit("_"), number.cast("string")))
    return F.concat(prefix, F.lit("table_"), F.coalesce(F.concat(file_id(table), F.lit("_")), F.lit("")), place, F.lit(".md"))


def sidecar_link(table: Column, number: Column, folder: str, file: Column) -> Column:
    return F.concat(F.lit("[Table "), F.coalesce(table, number.cast("string")), F.lit(f" — separate markdown]({folder}/"), file, F.lit(")"))


def normal_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", "")


def normal_column_name(name: Column) -> Column:
    """Column names compare by letters and digits."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def surname(author: Column) -> Column:
    """Of ``Given Family`` or ``Family, Given``."""
    name = F.trim(author)
    return blank_to_null(F.when(name.contains(","), F.trim(F.substring_index(name, ",", 1))).otherwise(F.element_at(F.split(name, r"\s+"), -1)))


def yaml_scalar(text: Column) -> Column:
    """Quoted where YAML needs it."""
    odd = text.rlike(r"""[:#\n"'`{}\[\]&*!|>%@]""") | (F.trim(text) != text)
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" ")), F.lit('"'))
    return F.when(text.isNull(), F.lit('""')).when(odd, quoted).otherwise(text)


def strip_fences(reply: Column) -> Column:
    """A model's reply without code fences and without what comes before its first pipe row."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\n", ""), r"\n?```\s*$", ""))
    at = F.locate("\n|", text)
    return F.when((at > 1) & ~F.ltrim(text).startswith("|"), F.substring(text, at + 1, F.length(text))).otherwise(text)


def same_article(reply: Column) -> Column:
    """A page-compare reply as ``struct<same, title>``; null if it says neither."""
    lines = F.filter(F.transform(F.split(F.trim(reply), r"\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.upper(F.element_at(F.split(F.try_element_at(lines, F.lit(1)), r"\s+"), 1))
    second = F.try_element_at(lines, F.lit(2))
    title = F.when(F.upper(second) != "NONE", second)
    return F.when(first.contains("SAME"), F.struct(F.lit(True).alias("same"), F.lit(None).cast("string").alias("title"))).when(first.contains("DIFFERENT"), F.struct(F.lit(False).alias("same"), title.alias("title")))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def memory_band(free_gb: Column) -> Column:
    """Free accelerator memory: below 4 GB too little, below 8 GB low."""
    return F.when(free_gb.isNull(), "unknown").when(free_gb < 4, "too-low").when(free_gb < 8, "low").otherwise("ok")


def content_hash(data: Column) -> Column:
    """Lower-case SHA-256 of a text's or file's bytes."""
    return F.sha2(data.cast("binary"), 256)


def yaml_block(fields: dict[str, Column]) -> Column:
    """``key: value`` lines between ``---`` lines, values quoted where YAML needs it; nulls are left out."""
    rows = F.array_compact(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), yaml_scalar(v.cast("string")))) for k, v in fields.items())))
    return F.concat(F.lit("---\n"), F.array_join(F.transform(rows, lambda x: F.concat(x, F.lit("\n"))), ""), F.lit("---\n"))


def record_json(fields: dict[str, Column]) -> Column:
    """The same fields as one JSON object; nulls are left out."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
