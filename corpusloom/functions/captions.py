"""Captions of figures and tables: predicates, labels, numbers, letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import CAPTION, FIGURE_LABEL, FOOTNOTE_OPENER, NUMBERED_LABEL, PANEL, WATERMARKS
from .text import all_matches, first_match

_PROPER = rf"^\s*{NUMBERED_LABEL}\s"
_MERGED = rf"(?s)^(.*?)({NUMBERED_LABEL})(?=[A-Za-z][a-z])(.*)$"
_ANCHOR = rf"(?i)(?:^|(?<=[.!?]\s)){FIGURE_LABEL}\s+\d+"
_LEADING = rf"(?i)^\s*(?:\(\s*([a-h])\s*\)|([a-h])\s*\)|([a-h]))\s+(?={FIGURE_LABEL}\s+\d+)"


def is_watermark(text: Column) -> Column:
    """A publisher's stamp, not a caption; blank texts aren't."""
    s = F.trim(F.coalesce(text, F.lit("")))
    stamp = s.rlike(WATERMARKS[0])
    for pattern in WATERMARKS[1:]:
        stamp = stamp | s.rlike(pattern)
    return (s != "") & ~s.rlike(rf"(?i)^{CAPTION[4:]}") & stamp


def is_caption(text: Column) -> Column:
    """A label with a number within the first hundred characters."""
    return F.coalesce(F.substring(text, 1, 100).rlike(CAPTION), F.lit(False))


def is_footnote(text: Column) -> Column:
    return F.coalesce(text.rlike(FOOTNOTE_OPENER), F.lit(False))


def is_primary(text: Column) -> Column:
    """A figure label, a separator and at least ten characters of caption."""
    return F.coalesce(text.rlike(rf"(?is)^\s*{PANEL}{FIGURE_LABEL}\s+\d+(?:\s*[|.,:]\s*|\s+(?=[A-Z(]))\S.{{9,}}"), F.lit(False))


def is_stub(text: Column) -> Column:
    """Nothing, panel letters, or a bare label."""
    bare = text.rlike(rf"(?i)^\s*(?:\(\s*[a-h]\s*\)\s*|[a-h]\s*\)?(?:\s+[a-h]\s*\)?)*\s*|{FIGURE_LABEL}\s+\d+\s*)$")
    return text.isNull() | (F.trim(text) == "") | F.coalesce(bare, F.lit(False))


def kind_and_number(text: Column) -> Column:
    """``struct<kind, number>`` of a caption that begins with a proper label, else null."""
    pattern = r"^\s*((?i:Fig(?:ure)?|Table|Plate|Scheme|Box))\.?\s*(\d+)[A-Za-z]?\.\s"
    kind = F.lower(F.regexp_extract(text, pattern, 1))
    return F.when(text.rlike(pattern), F.struct(F.when(kind.startswith("fig"), "fig").otherwise(kind).alias("kind"), F.regexp_extract(text, pattern, 2).try_cast("int").alias("number")))


def repair_label(text: Column) -> Column:
    """Move a label that was merged into the middle of a caption to its front; a proper caption stays as it is."""
    before, label, after = (F.regexp_extract(text, _MERGED, k) for k in (1, 2, 3))
    head = F.rtrim(before)
    moved = F.when(head == "", F.concat(label, F.lit(" "), after)).when(head.endswith("-") & after.rlike(r"^\p{Ll}"), F.concat(label, F.lit(" "), F.substring(head, F.lit(1), F.length(head) - 1), after)).otherwise(F.concat(label, F.lit(" "), head, F.lit(" "), after))
    return F.when(text.isNull() | (text == "") | text.rlike(_PROPER) | ~text.rlike(_MERGED), text).otherwise(moved)


def panel_letter(text: Column) -> Column:
    """The letter before a figure label."""
    found = F.concat(*(F.regexp_extract(text, _LEADING, k) for k in (1, 2, 3)))
    return F.when(text.rlike(_LEADING), F.lower(found))


def without_panel_letter(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _LEADING, "")


def figure_number(text: Column) -> Column:
    return first_match(text, rf"(?i)^\s*{PANEL}{FIGURE_LABEL}\s+(\d+)").try_cast("int")


def anchors(text: Column) -> Column:
    """Figure labels that begin a caption or a sentence."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_ANCHOR))


def panel_references(text: Column) -> Column:
    """Distinct panel letters that a caption explains."""
    return F.size(F.array_distinct(F.transform(all_matches(F.coalesce(text, F.lit("")), r"(?i)\b([a-h])[,.]\s+\S"), F.lower)))


def panel_letters(primary: Column, panels: Column) -> Column:
    """Letters of a figure's panels: the primary's own first, the others in order without it."""
    alphabet = F.array(*(F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz"))
    own = F.when(primary.rlike("^[a-z]$"), F.concat(F.array(primary), F.filter(alphabet, lambda c: c != primary))).otherwise(alphabet)
    return F.slice(own, F.lit(1), panels)


def figure_id(text: Column) -> Column:
    """Paper-relative id of a figure without its panel suffix: 1, A1, S2, ED1, A.1."""
    raw = first_match(text, r"(?i)^\s*\**\s*(?:Extended\s+Data\s+)?(?:Figure|Fig\.?)\s*(ED\d+|[A-Z]\.\d+|[A-Z]?\d+)[a-z]?(?:\([a-z]\))?")
    extended = text.rlike(r"(?i)^\s*\**\s*Extended\s+Data\s")
    return F.when(extended & raw.rlike(r"^\d"), F.concat(F.lit("ED"), raw)).otherwise(F.upper(raw))


def table_number(text: Column) -> Column:
    return first_match(text, r"(?i)^\s*\**\s*(?:Supplementary\s+|Extended\s+Data\s+)?Table\.?\s+(S?\d+|[A-Z]\.?\d+|S?[IVXLC]+)\b")


def table_in_html(html: Column) -> Column:
    """Table id within the first 250 characters of a table's HTML."""
    return first_match(F.substring(html, 1, 250), r"(?i)\bTable\s+(S?\d+|S?[IVXLC]+|[A-Z]\.?\d+)\b")


def roman(text: Column) -> Column:
    """Value of a roman numeral, by its letters only; null if another character is in it."""
    value = lambda c: F.element_at(F.create_map(*(F.lit(x) for pair in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in pair)), c)
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    step = lambda s, c: F.struct(F.when(value(c) < s["last"], s["total"] - value(c)).otherwise(s["total"] + value(c)).alias("total"), F.when(value(c) < s["last"], s["last"]).otherwise(value(c)).alias("last"))
    up = F.upper(text)
    return F.when(up.rlike("^[IVXLCDM]+$"), F.aggregate(F.split(F.reverse(up), ""), start, step, lambda s: s["total"]))


def table_id(raw: Column) -> Column:
    """Roman and arabic ids alike, an S before them kept."""
    rest = F.substring(raw, F.lit(2), F.length(raw))
    prefixed = raw.rlike("(?i)^s.")
    number = F.when(prefixed, roman(rest)).otherwise(roman(raw))
    return F.when(prefixed & rest.rlike("^[0-9]+$"), raw).when(number.isNotNull(), F.concat(F.when(prefixed, F.substring(raw, 1, 1)).otherwise(""), number.cast("string"))).otherwise(raw)


def is_table_image(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1)).startswith("table_")


