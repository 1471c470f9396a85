"""HTML tables as pipe tables, and what becomes of them.

General HTML needs a parser: the conversion is an Arrow-batched function of one column. Its
outcome rules are column expressions.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import equation_tags, sidecar_file

_TOKEN = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>", re.DOTALL)
_SPAN = re.compile(r"""(colspan|rowspan)\s*=\s*["']?\s*(\d+)""", re.IGNORECASE)


def cells(html: str) -> tuple[list[list[tuple[str, int]]], str]:
    """Rows of (text, column span), and what makes the table impossible to convert."""
    rows: list[list[tuple[str, int]]] = []
    row, cell, span, formula, depth, bad, at = None, None, 1, None, 0, "", 0

    def text(piece: str) -> None:
        if formula is not None:
            formula.append(entities.unescape(piece))
        elif cell is not None:
            cell.append(entities.unescape(piece))

    for found in _TOKEN.finditer(html):
        text(html[at : found.start()])
        at = found.end()
        closing, tag = bool(found[1]), (found[2] or "").lower()
        if tag == "table":
            depth += -1 if closing else 1
            if depth > 1:
                bad = "nested-table"
        elif tag == "tr":
            if closing and row is not None:
                rows.append(row)
            row = None if closing else []
        elif tag in ("td", "th") and not closing:
            spans = {k.lower(): int(v) for k, v in _SPAN.findall(found[3])}
            cell, span = [], max(1, spans.get("colspan", 1))
            if spans.get("rowspan", 1) > 1:
                bad = f"rowspan={spans['rowspan']}"
        elif tag in ("td", "th"):
            if row is not None and cell is not None:
                row.append((" ".join("".join(cell).split()).replace("|", "\\|"), span))
            cell, span = None, 1
        elif tag == "eq":
            if closing:
                expression = "".join(formula or []).strip()
                formula = None
                if cell is not None and expression:
                    cell.append(f"${expression}$")
            else:
                formula = []
        elif tag == "br" and cell is not None:
            cell.append("<br>")
    return rows, bad


def to_pipe(html: str | None) -> tuple[str | None, str]:
    """A pipe table, or the reason why there is none.

    Rows without wide cells are data and must agree in width; the first is the header. A row with
    a wide cell and at most two full cells is a section, in bold, dropped before the header.
    """
    if not html or not html.strip():
        return None, "empty-html"
    rows, bad = cells(html)
    if bad:
        return None, bad
    if not rows:
        return None, "no-rows"
    kept = []
    for row in rows:
        full = [t for t, _ in row if t.strip()]
        if not full:
            continue
        if all(n == 1 for _, n in row):
            kept.append((True, [t for t, _ in row]))
        elif len(full) <= 2:
            kept.append((False, full))
        else:
            return None, f"colspan-with-multi-content (non_empty={len(full)})"
    widths = sorted({len(r) for data, r in kept if data})
    if not widths:
        return None, "no-data-rows"
    if len(widths) > 1:
        return None, f"inconsistent-cols ({widths})"
    width, out = widths[0], []
    for data, row in kept:
        if data:
            out.append(f"| {' | '.join(row)} |")
            if len(out) == 1:
                out.append("|" + " --- |" * width)
        elif out:
            out.append(f"| **{' '.join(row)}** | {' | '.join([''] * (width - 1))} |")
    if sum(data for data, _ in kept) == 1:
        out.append(f"| {' | '.join([''] * width)} |")
    return "\n".join(out), ""


@F.pandas_udf(StructType([StructField("md", StringType()), StructField("reason", StringType())]))
def pipe_table(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([to_pipe(h) for h in html], columns=["md", "reason"])


def table_rows(html: str) -> list[tuple[int, int, str, int]]:
    """For a table function: row, cell, text and span of every cell."""
    return [(r, k, t, n) for r, row in enumerate(cells(html or "")[0]) for k, (t, n) in enumerate(row)]


def suspicious(md: Column) -> Column:
    """Why a pipe table looks wrong, null if it doesn't: under three rows, rows of different width, over 40 % blank body cells."""
    rows = F.filter(F.split(md, "\n"), lambda x: F.trim(x).startswith("|"))
    columns = lambda r: F.regexp_count(r, F.lit(r"(?<!\\)\|")) - 1
    widths = F.array_distinct(F.transform(rows, columns))
    body = F.slice(rows, F.lit(3), F.greatest(F.size(rows) - 2, F.lit(0)))
    blank = F.filter(body, lambda r: F.regexp_replace(r, r"[|\s]", "") == "")
    return F.when(F.size(rows) < 3, "too-few-rows").when(F.size(widths) > 1, "inconsistent-cols").when(F.size(blank) > 0.4 * F.size(body), "mostly-blank")


def outcomes(tables: DataFrame, force: bool = False, model: bool = False, inline: bool = True, folder: str = "assets") -> DataFrame:
    """Body, sidecar and score of every table block ``doc_id, page_idx, number, table_id, caption, html, image_path, footnote, rewritten``.

    ``rewritten`` is a model's table, null without one. Clean tables score 1.0, rewritten ones 0.85,
    those left as HTML 0.45, those without HTML 0.0.
    """
    t = tables.withColumn("pipe", pipe_table(F.coalesce("html", F.lit(""))))
    good = lambda md: md.isNotNull() & suspicious(md).isNull()
    none = F.coalesce(F.col("html"), F.lit("")) == ""
    clean = ~none & good(F.col("pipe.md"))
    redone = F.coalesce(good(F.col("rewritten")), F.lit(False)) & F.lit(model)
    reason = F.coalesce(F.nullif(F.col("pipe.reason"), F.lit("")), suspicious(F.col("pipe.md")), F.lit("suspicious"))
    kind = F.when(none, "no-html").when(clean & F.lit(force and model), "forced").when(clean, "clean").when(redone, "rewritten").otherwise("html")
    sidecar = F.when(kind.isin("clean"), F.col("pipe.md")).when(kind == "forced", F.when(redone, F.col("rewritten")).otherwise(F.col("pipe.md"))).when(kind == "rewritten", F.col("rewritten"))
    shown = F.when(kind.isin("clean", "forced"), F.col("pipe.md")).when(kind == "rewritten", F.col("rewritten")).when(kind == "html", equation_tags(F.col("html")))
    file = F.when(sidecar.isNotNull(), sidecar_file(F.lit(""), F.col("table_id"), F.col("page_idx"), F.col("number")))
    image = F.when(F.col("image_path").isNotNull(), F.concat(F.lit(f"\n\n![table]({folder}/"), "image_path", F.lit(")"))).otherwise("")
    note = F.regexp_replace(F.ltrim("footnote"), r"(?i)^Notes?\s*:\s*", "")
    note_md = F.when(F.coalesce(F.ltrim("footnote"), F.lit("")) != "", F.concat(F.lit("\n\n*Notes: "), note, F.lit("*"))).otherwise("")
    link = F.when(file.isNotNull(), F.concat(F.lit("\n[Table "), F.coalesce("table_id", F.col("number").cast("string")), F.lit(f" — separate markdown]({folder}/"), file, F.lit(")\n"))).otherwise("")
    head = F.concat(F.lit("\n**"), F.coalesce(F.trim("caption"), F.concat(F.lit("Table "), F.col("number").cast("string"))), F.lit("**"))
    md = F.concat(head, F.when(shown.isNotNull(), F.concat(F.lit("\n\n"), shown)).otherwise(""), image, note_md, link, F.lit("\n")) if inline else F.concat(image, note_md, link, F.lit("\n"))
    pre = F.when(kind == "no-html", "no-html-in-layout").when(kind == "forced", "force").when(kind.isin("rewritten", "html"), reason)
    post = F.when((kind == "forced") & ~redone, "model-empty-kept-pipe").when((kind == "html") & F.lit(not model), "model-disabled").when((kind == "html") & F.col("image_path").isNull(), "no-image").when((kind == "html") & F.col("rewritten").isNull(), "model-empty").when(kind == "html", suspicious(F.col("rewritten")))
    score = F.when(kind == "no-html", 0.0).when(kind.isin("clean", "forced"), 1.0).when(kind == "rewritten", 0.85).otherwise(0.45)
    return t.select("doc_id", "page_idx", "number", "table_id", kind.alias("outcome"), score.alias("score"), pre.alias("pre_redo_reason"), post.alias("post_redo_reason"), (redone & kind.isin("forced", "rewritten")).alias("redone"), file.alias("sidecar"), sidecar.alias("sidecar_md"), md.alias("md"))


def recovery_source(html: Column) -> Column:
    """Tag of a recovered table: from its HTML, raw HTML that doesn't convert, or nothing to convert."""
    pipe = pipe_table(F.coalesce(html, F.lit("")))
    return F.when(F.coalesce(F.trim(html), F.lit("")) == "", "layout_html_empty").when(pipe["md"].isNotNull(), "layout_html").otherwise("layout_html_raw")
