"""Files, caches and small operators that no query over the tables reaches."""

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import metadata, scoring
from corpusloom.sources import bundles, files, markdown


def test_discovered_files(spark, tmp_path):
    for name in ("b/x.pdf", "a.pdf", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF" * 3)
    assert [(r.stem, r.n_bytes) for r in files.discovered(spark, str(tmp_path)).collect()] == [("a", 12), ("x", 12)]


def test_layout_of_a_stem(spark):
    f = spark.createDataFrame([("/p/s/z_middle.json", "z"), ("/p/s/auto/z_middle.json", "z"), ("/p/b/y_middle.json", "y"), ("/p/a/y_middle.json", "y")], "path string, own string")
    assert {tuple(r) for r in files.layout_of(f, F.col("own")).collect()} == {("z", "/p/s/auto/z_middle.json"), ("y", "/p/a/y_middle.json")}


def test_spans_and_caches(spark, tmp_path):
    (tmp_path / "spans.json").write_text('{"doc_id": 1, "page_idx": 0, "text": "a", "size": 9.5, "flags": 1}\nnot json\n')
    assert [tuple(r) for r in files.read_spans(spark, str(tmp_path / "spans.json")).collect()] == [(1, 0, "a", 9.5, 1)]
    schema, at = "doi string, license string", str(tmp_path / "cache")
    assert files.load_cache(spark, at, schema).count() == 0
    for licence in ("cc-by", "cc0"):
        files.save_cache(spark.createDataFrame([("10.1/x", licence)], schema), at)
        assert [tuple(r) for r in files.load_cache(spark, at, schema).collect()] == [("10.1/x", licence)]


def test_written_documents(spark, tmp_path):
    d = spark.createDataFrame([(1, "---\na: 1\n---\nbody", "{}")], "doc_id long, md string, meta string")
    files.write_documents(d, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).collect() == d.collect()
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.md").write_text("---\na: 1\n---\nbody")
    r = markdown.read_markdown(spark, str(tmp_path / "m")).select(markdown.front_matter(F.col("md")), markdown.body(F.col("md"))).first()
    assert tuple(r) == ("a: 1\n", "body")
    markdown.append_manifest(d, str(tmp_path / "j"))
    markdown.append_manifest(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    markdown.write_tsv(d.select("doc_id"), str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).first().doc_id == "1"


def test_small_functions(spark):
    one = spark.range(1)
    got = one.select(
        text.iso_utc(F.lit("2020-01-02 03:04:05").cast("timestamp")),
        text.memory_band(F.lit(5.0)),
        text.memory_band(F.lit(None).cast("double")),
        bundles.kept_asset(F.lit("a.PNG")),
        bundles.pdf_name(F.lit("/x/y.pdf")),
        markdown.accepted_pdf(F.lit("application/pdf"), F.lit("u"), F.lit(2000)),
        markdown.accepted_pdf(F.lit(None).cast("string"), F.lit("http://x/y.PDF"), F.lit(10)),
        scoring.block_figure_score(F.lit("Figure 1. All")),
    ).first()
    assert tuple(got) == ("2020-01-02T03:04:05Z", "low", "unknown", True, "y.pdf", True, False, 1.0)


def test_repeated_responses_keep_one_document(spark):
    a = spark.createDataFrame([(1, "10.1/x", None, "high")], "doc_id long, doi string, arxiv_id string, confidence string")
    ox = spark.createDataFrame([("10.1/x", "cc-by", "gold", "u", 2020)] * 3, "doi string, license string, oa_status string, oa_url string, year int")
    none = lambda ddl: spark.createDataFrame([], ddl)
    out = metadata.resolved(a, ox, none("doi string, license string, is_oa boolean, pdf_url string"), none("doi string, license string, pmcid string, has_pdf string, is_open string, year int"), none("doi string, osti_id string, fulltext_url string"), none("arxiv_id string, license string"), 2026)
    assert out.count() == 1


def test_references_in_order(spark):
    ids = spark.createDataFrame([(1, ["b", "a", "gone", "b"])], "doc_id long, ids array<string>")
    works = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, entry string")
    assert metadata.ordered_references(ids, works).first().entries == ["B", "A", "B"]
