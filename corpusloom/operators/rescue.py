"""Captions and panels that the layout left apart from their figures and tables.

Blocks are rows ``doc_id, page_idx, idx, type, bbox, text, image_path, footnote`` (more columns stay).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import captions as c
from ..functions import geometry as g

PARENTS = ("image", "chart", "table")
MAX_TEXT_HEIGHT = 500
CAP = 4


def candidates(blocks: DataFrame) -> DataFrame:
    """Every caption or footnote that a parent could adopt: ``doc_id, page_idx, parent, text, what, gap``.

    A parent wants a caption if it has none or a publisher's stamp, a table wants a footnote if it
    has none. The pairs are within a page, so the join is on document and page.
    """
    p, t = blocks.where(F.col("type").isin(*PARENTS)).alias("p"), blocks.where((F.col("type") == "text") & (F.col("text") != "")).alias("t")
    wants_caption = (F.coalesce(F.col("p.text"), F.lit("")) == "") | c.is_watermark(F.col("p.text"))
    wants_footnote = (F.col("p.type") == "table") & (F.coalesce(F.col("p.footnote"), F.lit("")) == "")
    near = p.join(t, (F.col("p.doc_id") == F.col("t.doc_id")) & (F.col("p.page_idx") == F.col("t.page_idx"))).where(g.adjacent(F.col("p.bbox"), F.col("t.bbox")) & g.x_compatible(F.col("p.bbox"), F.col("t.bbox")) & ~F.coalesce(g.height(F.col("t.bbox")) > MAX_TEXT_HEIGHT, F.lit(False)))
    whats = F.array_compact(F.array(F.when(wants_caption & c.is_caption(F.col("t.text")), "caption"), F.when(wants_footnote & c.is_footnote(F.col("t.text")), "footnote")))
    return near.select(F.col("p.doc_id").alias("doc_id"), F.col("p.page_idx").alias("page_idx"), F.col("p.idx").alias("parent"), F.col("t.idx").alias("child"), F.col("t.text").alias("text"), F.explode(whats).alias("what"), g.vertical_gap(F.col("p.bbox"), F.col("t.bbox")).alias("gap"))


def nearest(blocks: DataFrame) -> DataFrame:
    """For each parent and want the closest candidate, ties by order on the page; parents don't compete here."""
    best = F.row_number().over(Window.partitionBy("doc_id", "page_idx", "parent", "what").orderBy("gap", "child"))
    return candidates(blocks).withColumn("rank", best).where("rank = 1").drop("rank")


def _greedy(page: pd.DataFrame) -> pd.DataFrame:
    """Parents in page order take their closest candidate that no parent before them took."""
    taken, rows = set(), []
    for parent, mine in page.sort_values(["parent", "gap", "child"], kind="stable").groupby("parent", sort=True):
        for what in ("caption", "footnote"):
            # both wants are weighed on what was free when the parent's turn came
            free = mine[(mine["what"] == what) & ~mine["child"].isin(taken)]
            if len(free):
                rows.append(free.iloc[0])
        taken.update(r["child"] for r in rows if r["parent"] == parent)
    return pd.DataFrame(rows, columns=page.columns)


def adopted(blocks: DataFrame) -> DataFrame:
    """``doc_id, page_idx, parent, child, text, what, gap``: what each parent adopts, in page order, each text once.

    Where no text is wanted by two parents the closest candidates are the answer. On the other
    pages turns depend on one another, and a page's few candidates go through one function.
    """
    page = Window.partitionBy("doc_id", "page_idx")
    rivals = F.size(F.collect_set("parent").over(Window.partitionBy("doc_id", "page_idx", "child")))
    found = candidates(blocks).withColumn("rivals", rivals).withColumn("contested", F.max("rivals").over(page) > 1).drop("rivals")
    best = F.row_number().over(Window.partitionBy("doc_id", "page_idx", "parent", "what").orderBy("gap", "child"))
    plain = found.where("not contested").withColumn("rank", best).where("rank = 1").drop("rank", "contested")
    rest = found.where("contested").drop("contested")
    return plain.unionByName(rest.groupBy("doc_id", "page_idx").applyInPandas(_greedy, rest.schema))


def three_columns(blocks: DataFrame, sizes: DataFrame | None = None, width: float = 612.0) -> DataFrame:
    """``doc_id, page_idx, three_columns``: at least four text blocks in three or more sixths of the page, no sixth with 80 % of them."""
    text = blocks.where(F.col("type").isin("text", "ref_text") & F.col("bbox").isNotNull())
    if sizes is not None:
        text = text.join(sizes.select("doc_id", "page_idx", "width"), ["doc_id", "page_idx"], "left")
    else:
        text = text.withColumn("width", F.lit(width))
    bins = F.floor((F.col("bbox.x0") + F.col("bbox.x1")) / 2 / (F.coalesce("width", F.lit(width)) / 6))
    by_bin = text.groupBy("doc_id", "page_idx", bins.alias("bin")).agg(F.count("*").alias("n"))
    by_page = by_bin.groupBy("doc_id", "page_idx").agg(F.sum("n").alias("blocks"), F.count("*").alias("bins"), F.max("n").alias("most"))
    return by_page.select("doc_id", "page_idx", ((F.col("blocks") >= 4) & (F.col("bins") >= 3) & (F.col("most") < 0.8 * F.col("blocks"))).alias("three_columns"))


def by_label(blocks: DataFrame, sizes: DataFrame | None = None, width: float = 612.0) -> DataFrame:
    """On three-column pages the one parent of a kind that needs a caption gets the one text that begins with a label of that kind.

    A caption that isn't one is only given up for a better one; kinds with several such parents or
    texts stay as they are. All counts are windows within a page, so the blocks move once.
    """
    rows = blocks
    if sizes is not None:
        rows = rows.join(sizes.select("doc_id", "page_idx", F.col("width").alias("_width")), ["doc_id", "page_idx"], "left")
    else:
        rows = rows.withColumn("_width", F.lit(width))
    over = lambda *more: Window.partitionBy("doc_id", "page_idx", *more)
    count = lambda what, *more: F.count(F.when(what, 1)).over(over(*more))
    is_text = F.col("type").isin("text", "ref_text") & F.col("bbox").isNotNull()
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    poor = empty | c.is_watermark(F.col("text")) | (~c.is_caption(F.col("text")) & ~c.is_stub(F.col("text")))
    label = F.when(F.col("type") == "text", c.kind_and_number(F.col("text")))
    needs = F.col("type").isin(*PARENTS) & poor
    kind = F.when(needs, F.when(F.col("type") == "table", "table").otherwise("fig")).otherwise(label["kind"])
    center = (F.col("bbox.x0") + F.col("bbox.x1")) / 2
    rows = rows.withColumns({"_is_text": is_text, "_bin": F.when(is_text, F.floor(center / (F.coalesce("_width", F.lit(width)) / 6))), "_needs": F.coalesce(needs, F.lit(False)), "_kind": kind, "_number": label["number"], "_labelled": label.isNotNull()})
    rows = rows.withColumns({"_in_bin": count(F.col("_is_text"), "_bin"), "_blocks": count(F.col("_is_text")), "_bins": F.size(F.collect_set("_bin").over(over())), "_unique": F.col("_labelled") & (count(F.col("_labelled"), "_kind", "_number") == 1)})
    three = (F.col("_blocks") >= 4) & (F.col("_bins") >= 3) & (F.max(F.when(F.col("_is_text"), F.col("_in_bin"))).over(over()) < 0.8 * F.col("_blocks"))
    own = F.max(F.when(F.col("_unique"), c.repair_label(F.trim("text")))).over(over("_kind"))
    rows = rows.withColumns({"_ok": F.coalesce(three & (count(F.col("_needs"), "_kind") == 1) & (count(F.col("_unique"), "_kind") == 1), F.lit(False)), "_own": own})
    return rows.withColumns({"text": F.when(F.col("_ok") & F.col("_needs"), F.col("_own")).otherwise(F.col("text")), "type": F.when(F.col("_ok") & F.col("_unique"), "_adopted_caption").otherwise(F.col("type"))}).select(blocks.columns)


def with_captions(blocks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Blocks after both passes: adopted texts change their type, parents get caption and footnote."""
    key = ["doc_id", "page_idx", "idx"]
    is_caption = F.col("what") == "caption"
    ends = F.array(F.struct(F.col("parent").alias("idx"), F.when(is_caption, F.trim("text")).alias("new_text"), F.when(~is_caption, F.trim("text")).alias("new_note"), F.lit(None).cast("string").alias("gone")), F.struct(F.col("child").alias("idx"), F.lit(None).cast("string").alias("new_text"), F.lit(None).cast("string").alias("new_note"), F.col("what").alias("gone")))
    changes = adopted(blocks).select("doc_id", "page_idx", F.explode(ends).alias("e")).select("doc_id", "page_idx", "e.*").groupBy(*key).agg(F.max("new_text").alias("new_text"), F.max("new_note").alias("new_note"), F.min("gone").alias("gone"))
    both = blocks.join(changes, key, "left")
    first = both.withColumns({"text": F.coalesce(c.repair_label(F.col("new_text")), "text"), "footnote": F.coalesce("new_note", "footnote"), "type": F.when(F.col("gone").isNotNull(), F.concat(F.lit("_adopted_"), "gone")).otherwise(F.col("type"))}).select(blocks.columns)
    return by_label(first, sizes)


def panels(blocks: DataFrame) -> DataFrame:
    """Which primary figure each stub belongs to: ``doc_id, page_idx, primary, stub, how``.

    Letter and empty stubs flow to the next primary on their page, the last ones to the last
    primary; a primary that would get more than its caption can explain (at least four) gets none.
    Numbered stubs go to the first primary with their number. A caption that holds two figures
    takes no panels.
    """
    figures = blocks.where(F.col("type").isin("image", "chart")).select("doc_id", "page_idx", "idx", "text", c.is_primary(F.col("text")).alias("is_primary"), c.figure_number(F.col("text")).alias("number"), c.anchors(F.col("text")).alias("anchors"), c.panel_references(F.col("text")).alias("refs"), c.is_stub(F.col("text")).alias("is_stub"))
    page = Window.partitionBy("doc_id", "page_idx")
    ahead = page.orderBy("idx").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    own = F.when(F.col("is_primary"), F.col("idx"))
    flow = figures.withColumns({"next": F.first(own, ignorenulls=True).over(ahead), "last": F.max(own).over(page)})
    primaries = figures.where("is_primary").select("doc_id", "page_idx", F.col("idx").alias("primary"), "anchors", "refs", "number")
    lettered = flow.where("not is_primary and is_stub and number is null and last is not null").select("doc_id", "page_idx", F.coalesce("next", "last").alias("primary"), F.col("idx").alias("stub"))
    counted = lettered.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "page_idx", "primary"))).join(primaries.drop("number"), ["doc_id", "page_idx", "primary"]).where(F.col("n") <= F.greatest("refs", F.lit(CAP)))
    first = primaries.where("number is not null").groupBy("doc_id", "page_idx", "number").agg(F.min_by(F.struct("primary", "anchors"), "primary").alias("p")).select("doc_id", "page_idx", "number", "p.*")
    numbered = figures.where("not is_primary and is_stub and number is not null").select("doc_id", "page_idx", "number", F.col("idx").alias("stub")).join(first, ["doc_id", "page_idx", "number"])
    cols = ["doc_id", "page_idx", "primary", "stub", "anchors"]
    return counted.select(*cols, F.lit("flow").alias("how")).unionByName(numbered.select(*cols, F.lit("number").alias("how"))).where("anchors < 2").drop("anchors")


def panel_groups(blocks: DataFrame) -> DataFrame:
    """One row a consolidated figure: ``doc_id, page_idx, primary, caption, figure_number, letters, paths``."""
    key = ["doc_id", "page_idx"]
    stubs = panels(blocks).join(blocks.select(*key, F.col("idx").alias("stub"), F.col("image_path").alias("path")), [*key, "stub"])
    order = F.struct(F.when(F.col("how") == "flow", 0).otherwise(1), "stub", "path")
    by = stubs.groupBy(*key, "primary").agg(F.filter(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["path"]), lambda p: p.isNotNull()).alias("others"))
    own = blocks.select(*key, F.col("idx").alias("primary"), "text", "image_path")
    both = by.join(own, [*key, "primary"])
    paths = F.concat(F.array("image_path"), "others")
    cleaned = c.without_panel_letter(F.col("text"))
    return both.select(*key, "primary", cleaned.alias("caption"), c.figure_number(cleaned).alias("figure_number"), c.panel_letters(c.panel_letter(F.col("text")), F.size(paths)).alias("letters"), paths.alias("paths"))


def footnote_extension(tables: DataFrame, texts: DataFrame, share: float = 0.25) -> DataFrame:
    """``doc_id, page_idx, table_idx, y1``: a table's lower edge with the footnotes right below it, by at most a quarter of the page.

    ``texts`` are blocks below; the run stops at the first that isn't a footnote.
    """
    key = ["doc_id", "page_idx", "table_idx"]
    below = tables.select("doc_id", "page_idx", F.col("idx").alias("table_idx"), F.col("bbox").alias("t"), "page_height").join(texts.select("doc_id", "page_idx", "idx", "bbox", "text"), ["doc_id", "page_idx"]).where(F.col("bbox.y0") >= F.col("t.y1"))
    run = Window.partitionBy(*key).orderBy("bbox.y0", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    good = below.withColumn("going", F.min(c.is_footnote(F.col("text")).cast("int")).over(run)).where((F.col("going") == 1) & (F.col("bbox.y1") <= F.col("t.y1") + share * F.col("page_height")))
    ends = good.groupBy(*key).agg(F.max("bbox.y1").alias("end"))
    return tables.select("doc_id", "page_idx", F.col("idx").alias("table_idx"), F.col("bbox.y1").alias("y")).join(ends, key, "left").select(*key, F.coalesce("end", "y").alias("y1"))


def page_local(matches: DataFrame, own_captions: DataFrame) -> DataFrame:
    """Figure matches ``doc_id, filename, image_page, figure, caption_page``: kept on the caption's page, kept one page away if their own page has no other caption, else dropped."""
    others = own_captions.select("doc_id", F.col("page").alias("image_page"), F.col("figure").alias("other")).distinct()
    other = matches.join(others, ["doc_id", "image_page"]).where("other <> figure").select("doc_id", "filename").distinct().withColumn("has_other", F.lit(True))
    away = F.abs(F.col("image_page") - F.col("caption_page"))
    verdict = F.when(F.col("caption_page").isNull(), "unknown").when(away == 0, "same-page").when(away > 1, "too-far").when(F.coalesce("has_other", F.lit(False)), "other-caption").otherwise("neighbour")
    return matches.join(other, ["doc_id", "filename"], "left").select("doc_id", "filename", "figure", verdict.alias("verdict"))


def adoption_counts(blocks: DataFrame) -> DataFrame:
    """``doc_id, parents, captions, footnotes``: image, chart and table blocks of each document, and the texts they adopt."""
    parents = blocks.where(F.col("type").isin(*PARENTS)).groupBy("doc_id").agg(F.count("*").alias("parents"))
    taken = adopted(blocks).groupBy("doc_id").agg(F.count_if(F.col("what") == "caption").alias("captions"), F.count_if(F.col("what") == "footnote").alias("footnotes"))
    return parents.join(taken, "doc_id", "left").na.fill(0, ["captions", "footnotes"])
