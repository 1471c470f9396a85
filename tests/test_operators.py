"""Operators on small inputs: rules, ties, repeats, idempotence."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import udfs
from corpusloom.operators import batch, emit, matching, references, rescue, rewrites, scoring, tables
from corpusloom.plans import inputs
from corpusloom.plans.cases import CASES
from corpusloom.plans.registry import made

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


@pytest.mark.parametrize(
    "html, md, reason",
    [
        ("", None, "empty-html"),
        ("<p>x</p>", None, "no-rows"),
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2|3</td></tr></table>", "| a | b |\n| --- | --- |\n| 1 | 2\\|3 |", ""),
        ("<table><tr><td>a</td></tr></table>", "| a |\n| --- |\n|  |", ""),
        ("<table><tr><td rowspan='3'>a</td></tr></table>", None, "rowspan=3"),
        ("<table><tr><td><table></table></td></tr></table>", None, "nested-table"),
        ("<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>", None, "inconsistent-cols ([1, 2])"),
        ("<table><tr><td colspan=3>a</td><td>b</td><td>c</td></tr></table>", None, "colspan-with-multi-content (non_empty=3)"),
        ("<table><tr><td colspan=2>drop</td></tr><tr><td>a</td><td>b</td></tr><tr><td colspan=2>keep</td></tr><tr><td>1<br>2</td><td><eq>x</eq></td></tr></table>", "| a | b |\n| --- | --- |\n| **keep** |  |\n| 1<br>2 | $x$ |", ""),
        ("<table><tr><td></td></tr></table>", None, "no-data-rows"),
    ],
)
def test_pipe_tables(html, md, reason):
    assert tables.to_pipe(html) == (md, reason)


def test_pipe_table_of_null():
    assert tables.to_pipe(None) == (None, "empty-html")


def test_suspicious(spark):
    rows = [("| a |\n| --- |", "too-few-rows"), ("| a |\n| --- |\n| b | c |", "inconsistent-cols"), ("| a |\n| --- |\n|  |\n|  |\n| x |", "mostly-blank"), ("| a |\n| --- |\n| b |", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "md string, want string").select(tables.suspicious(F.col("md"))).collect()]
    assert got == [w for _, w in rows]


def test_parents_compete_for_a_caption(spark):
    box = lambda y0, y1: (50.0, float(y0), 300.0, float(y1))
    rows = [(1, 0, 0, "image", box(0, 100), None, None), (1, 0, 1, "text", box(105, 120), "Figure 1. The only caption", None), (1, 0, 2, "image", box(121, 200), "", None)]
    blocks = spark.createDataFrame(rows, f"doc_id long, page_idx int, idx int, type string, bbox {BOX}, text string, footnote string")
    assert {(r.parent, r.child) for r in rescue.nearest(blocks).collect()} == {(0, 1), (2, 1)}
    assert [(r.parent, r.child) for r in rescue.adopted(blocks).collect()] == [(0, 1)]
    after = {r.idx: (r.type, r.text) for r in rescue.with_captions(blocks).collect()}
    assert after == {0: ("image", "Figure 1. The only caption"), 1: ("_adopted_caption", "Figure 1. The only caption"), 2: ("image", "")}


def test_three_columns_by_label(spark):
    rows = [(1, 0, k, "text", (x, 400.0, x + 100.0, 500.0), t, None) for k, (x, t) in enumerate([(30.0, "Fig. 2. The caption of it"), (230.0, "middle"), (430.0, "right"), (30.0, "more")])]
    rows.append((1, 0, 9, "image", (30.0, 10.0, 130.0, 90.0), "some body text that was nested here", None))
    blocks = spark.createDataFrame(rows, f"doc_id long, page_idx int, idx int, type string, bbox {BOX}, text string, footnote string")
    got = {r.idx: r.text for r in rescue.with_captions(blocks).collect()}
    assert got[9] == "Fig. 2. The caption of it"


def test_plate_pages_stay_apart(spark):
    rows = [(1, 0, k, None, f"{k}.jpg") for k in range(6)] + [(1, 0, 9, "Fig. 2. One of the same pieces broken", "p.jpg")]
    blocks = spark.createDataFrame(rows, "doc_id long, page_idx int, idx int, text string, image_path string").withColumn("type", F.lit("image"))
    assert rescue.panels(blocks).count() == 0


def test_two_figures_in_a_caption_take_no_panels(spark):
    rows = [(1, 0, 0, "a", "a.jpg"), (1, 0, 1, "Fig. 6. First of them. Fig. 7. Second of them", "p.jpg")]
    blocks = spark.createDataFrame(rows, "doc_id long, page_idx int, idx int, text string, image_path string").withColumn("type", F.lit("image"))
    assert rescue.panels(blocks).count() == 0


def _score(spark, md):
    return references.scored(spark.createDataFrame([(1, md)], "doc_id long, md string")).first()


def test_reference_scores(spark):
    good = "## References\n" + "\n".join(f"{k}. Smith, A. Some title of it, Journal {k} (19{60 + k})." for k in range(1, 9))
    assert _score(spark, good).score >= 0.85
    assert _score(spark, good).numbered_continuous
    assert _score(spark, "nothing here").score == 0.0
    assert _score(spark, None).score == 0.0
    mega = good + "\n9. " + "very long entry " * 120
    assert _score(spark, mega).longest_over_median > 5
    assert _score(spark, good.replace(" (19", " (no")).score < 0.7
    assert _score(spark, "## References\n1. A (1990)").score <= 0.5


def test_heading_rescue_is_idempotent(spark):
    docs = made(spark, "/root/testdata/sf0.001", inputs.REFERENCES)
    once = docs.select("doc_id", references.with_heading(F.col("md")).alias("md")).persist()
    again = once.select("doc_id", "md", references.with_heading(F.col("md")).alias("twice"))
    assert again.where("md <> twice").count() == 0


def test_partitioning_does_not_matter(spark):
    docs = made(spark, "/root/testdata/sf0.001", inputs.BLOCKS)
    b = docs.withColumn("bbox", F.struct(*(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))))
    one, seven = (emit.assembled(b.repartition(n)).orderBy("doc_id").toPandas() for n in (1, 7))
    pd.testing.assert_frame_equal(one, seven)


def test_renumber_without_anchor_stays_open(spark):
    a = spark.createDataFrame([(1, 1, 0, None), (1, 1, 1, None)], "doc_id long, page int, id_n int, captured int")
    assert {r.number for r in rewrites.renumbered(a).collect()} == {None}


def test_pairs_and_orphans(spark):
    files = spark.createDataFrame([("foo",), ("foo_SI",), ("foo_supp",), ("bar-maintext",), ("bar-supplemental",), ("lone_S1",)], "stem string")
    assert {tuple(r) for r in batch.paired(files).collect()} == {("foo", "foo_SI", "main"), ("foo", "foo_supp", "further-supplement"), ("bar-maintext", "bar-supplemental", "main"), ("lone_S1", None, "orphan-supplement")}


def test_grades(spark):
    got = spark.createDataFrame([(0.9,), (0.8,), (0.7,), (0.6,), (0.59,)], "s double").select(scoring.grade(F.col("s"))).collect()
    assert [r[0] for r in got] == ["A", "B", "C", "D", "F"]


def test_paths(spark):
    wanted = spark.createDataFrame([(1, "a.jpg"), (1, "b.jpg")], "doc_id long, name string")
    files = spark.createDataFrame([("images/a.jpg",), ("a.jpg",)], "path string")
    assert {tuple(r) for r in matching.resolved_paths(wanted, files).collect()} == {(1, "a.jpg", "images/a.jpg"), (1, "b.jpg", None)}


def test_function_cases_on_nulls(spark):
    empty = spark.createDataFrame([(None,), ("",)], "t string")
    for name, f, _, _ in CASES:
        assert empty.select(f(F.col("t"))).count() == 2, name


def test_model_that_fails_on_one_text(spark):
    def model(texts):
        if "bad" in texts:
            raise ValueError("bad")
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "d")], "n int, text string").coalesce(1)
    assert {r.n: r.out for r in rows.select("n", udfs.model_column(model)("text").alias("out")).collect()} == {1: "A", 2: None, 3: "", 4: "D"}
