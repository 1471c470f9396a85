"""Functions of one text with an example each: what goes in and what must come out.

``@`` in an example stands for a document's id, so every document runs every example on a text of
its own. The same table feeds the query and the tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import captions, identity, text
from ..operators import batch, metadata, references, rewrites
from .registry import query, table


def joined(values: Column) -> Column:
    return F.array_join(values, "|")


SPAN = '<span id="page-9-1"></span>'

#: Name, function of a column, text, result (null for None).
CASES = [
    ("alt_text", text.alt_text, "a [b]\n c @", "a (b) c @"),
    ("equation_tags", text.equation_tags, "<td><eq>x^@</eq></td>", "<td>$x^@$</td>"),
    ("chart_details", text.strip_chart_details, "a <details><summary>line</summary>1 2\n3</details>b @", "a b @"),
    ("file_id", text.file_id, " A.@ ", "A_@"),
    ("normal_title", text.normal_title, "The Title: @!", "thetitle@"),
    ("surname_last", text.surname, "Ada B. Lovelace@", "Lovelace@"),
    ("surname_first", text.surname, "Lovelace@, Ada", "Lovelace@"),
    ("yaml_plain", text.yaml_scalar, "plain text @", "plain text @"),
    ("yaml_quoted", text.yaml_scalar, 'a: "b" @', '"a: \\"b\\" @"'),
    ("fences", text.strip_fences, "```md\nHere:\n| a | @ |\n```", "| a | @ |"),
    ("reply_same", lambda c: text.same_article(c)["same"].cast("string"), "SAME\n@", "true"),
    ("reply_title", lambda c: text.same_article(c)["title"], "DIFFERENT page\nA new title @", "A new title @"),
    ("reply_none", lambda c: text.same_article(c)["title"], "DIFFERENT\nNONE", None),
    ("caption_kind", lambda c: captions.kind_and_number(c)["kind"], "FIGURE 2. Plot of @", "fig"),
    ("caption_number", lambda c: captions.kind_and_number(c)["number"].cast("string"), "Table 12b. Plot of @", "12"),
    ("repair_middle", captions.repair_label, "Growth of the Fig. 1.crystal layer @", "Fig. 1. Growth of the crystal layer @"),
    ("repair_hyphen", captions.repair_label, "Thermal contrac- Fig. 2.tion under load @", "Fig. 2. Thermal contraction under load @"),
    ("repair_none", captions.repair_label, "Fig. 3. shown in Fig. 1. The @", "Fig. 3. shown in Fig. 1. The @"),
    ("panel_strip", captions.without_panel_letter, "(c) Figure 1. body @", "Figure 1. body @"),
    ("anchors", lambda c: captions.anchors(c).cast("string"), "Fig. 6. One. Fig. 7. Two of @", "2"),
    ("anchors_cross", lambda c: captions.anchors(c).cast("string"), "Figure 3 | from the Fig. 1 run @", "1"),
    ("panel_refs", lambda c: captions.panel_references(c).cast("string"), "Figure 1 | a, one. b, two. a, again @", "2"),
    ("figure_id", captions.figure_id, "Fig. S2a. Of @", "S2"),
    ("figure_id_extended", captions.figure_id, "Extended Data Fig. 3 | of @", "ED3"),
    ("table_number", captions.table_number, "**Table IV.** Of @", "IV"),
    ("table_html", captions.table_in_html, "<table><tr><td>Table S5: of @</td>", "S5"),
    ("roman", lambda c: captions.roman(c).cast("string"), "xciv", "94"),
    ("roman_bad", lambda c: captions.roman(c).cast("string"), "IVa@", None),
    ("table_id_roman", captions.table_id, "V", "5"),
    ("table_id_supplement", captions.table_id, "SIV", "S4"),
    ("table_id_kept", captions.table_id, "A.@", "A.@"),
    ("doi_clean", identity.clean_doi, " 10.1000/ABC@).", "10.1000/abc@"),
    ("doi_blocked", identity.clean_doi, "10.5555/@", None),
    ("failure_memory", batch.failure_kind, "x\nRuntimeError: CUDA out of memory @", "cuda_oom"),
    ("failure_model", batch.failure_kind, "FileNotFoundError: a/b@.onnx", "model_load"),
    ("failure_other", batch.failure_kind, "something @", "unknown"),
    ("log_tail", lambda c: batch.log_tail(c, 2), "a\nb\n@", "b\n@"),
    ("crossref_own", lambda c: metadata.crossref_bullet(c, F.lit(3)), '{"unstructured":"A.  Smith,\\n J. @"}', "- 3. A. Smith, J. @"),
    ("crossref_fields", lambda c: metadata.crossref_bullet(c, F.lit(1)), '{"author":"Smith","year":"1990","journal-title":"Nature","volume":"@","DOI":"10.1/x"}', "- 1. Smith, (1990), *Nature*, vol. @, [doi:10.1/x](https://doi.org/10.1/x)."),
    ("crossref_empty", lambda c: metadata.crossref_bullet(c, F.lit(1)), '{"x":"@"}', "- 1. (incomplete reference)"),
    ("crossref_year", lambda c: metadata.crossref_year(c).cast("string"), '{"issued":{"date-parts":[[1999,1]]},"id":"@"}', "1999"),
    ("openalex", lambda c: metadata.openalex_bullet(c, F.lit(2)), '{"authorships":[{"author":{"display_name":"A B"}}],"publication_year":2001,"display_name":"T @","doi":"https://doi.org/10.1/y"}', "- 2. A B, (2001), T @, [doi:10.1/y](https://doi.org/10.1/y)."),
    ("line_numbers", rewrites.strip_line_numbers, "a\n 12 \nb @", "a\nb @"),
    ("footers", rewrites.strip_running_footers, "a\nSMITH ET AL. 3 of 9\n| X ET AL. 1 of 2\nb @", "a\n| X ET AL. 1 of 2\nb @"),
    ("headers", rewrites.strip_page_headers, "**ARTICLES**\n- NATURE DOI: 10.1/x\nb @", "- NATURE DOI: 10.1/x\nb @"),
    ("stamps", rewrites.strip_stamps, "a\nonlinelibrary.wiley.com/doi/1 by X\nsee http://onlinelibrary.wiley.com/2\nb @", "a\nsee http://onlinelibrary.wiley.com/2\nb @"),
    ("stamps_in_code", rewrites.strip_stamps, "```\nSee the Terms and Conditions\n```\n@", "```\nSee the Terms and Conditions\n```\n@"),
    ("math_labels", rewrites.strip_math_labels, "$$x \\label{eq:@}$$ in \\eqref{eq:@}", "$$x $$ in (eq:@)"),
    ("spans", rewrites.normal_spans, f"{SPAN}Smith @\n{SPAN}Jones", f"- {SPAN}Smith @\n- {SPAN}Jones"),
    ("span_alone", rewrites.normal_spans, f"a\n{SPAN}Smith @\nb", f"a\n{SPAN}Smith @\nb"),
    ("split_doi", rewrites.normal_spans, "x [http://dx.doi.org/](u1) [10.1000/0001-002X\\(90\\)@-5](u2) y", "x <https://doi.org/10.1000/0001-002X(90)@-5> y"),
    ("wrappers", rewrites.normal_spans, "[A title](http://refhub.elsevier.com/S1(2)@) end", "A title end"),
    ("footnotes", rewrites.consolidated_footnotes, "Body<sup>2</sup> text\n<sup>2</sup> B. Two (1961). <sup>3</sup> C. Three\nmore @\n<sup>1</sup> A. One (1960).", "Body<sup>2</sup> text\nmore @\n\n## References\n\n1. A. One (1960).\n2. B. Two (1961).\n3. C. Three\n"),
    ("footnotes_headed", rewrites.consolidated_footnotes, "## References\n<sup>1</sup> A @", "## References\n<sup>1</sup> A @"),
    ("orphans", rewrites.with_orphan_headings, "text @\n- 46 A (1990)\n- 47A. B (1991)\n- 48 C\nend", "text @\n## References\n\n- 46 A (1990)\n- 47A. B (1991)\n- 48 C\nend"),
    ("orphans_steps", rewrites.with_orphan_headings, "- 1 open\n- 2 run\n- 3 close @", "- 1 open\n- 2 run\n- 3 close @"),
    ("merge", rewrites.merged_sections, "a\n### References\n1. A\n### Methods\nm @\n# **References**\n2. B", "a\n### Methods\nm @\n\n## References\n\n1. A\n2. B\n"),
    ("merge_two", rewrites.merged_sections, "a\n## References\n1. A\n## Methods\nm @\n## References\n2. B", "a\n## Methods\nm @\n\n## References\n\n1. A\n2. B\n"),
    ("tidy", lambda c: joined(rewrites.tidy_entries(F.split(c, "\n"))), "Smith, J., A title\n- that goes on @\n- Jones, K., Other\n- K. Doe, Unit 7, Some Lab, TX 75001.", "- Smith, J., A title that goes on @|- Jones, K., Other||K. Doe, Unit 7, Some Lab, TX 75001."),
    ("aps", lambda c: rewrites.aps_heading(c, F.lit("aps-prl")), "end @\n[1] A x\n[2] B x\n[3] C x\n[4] D x\n[5] E x", "end @\n\n## References\n\n[1] A x\n[2] B x\n[3] C x\n[4] D x\n[5] E x\n"),
    ("aps_other", lambda c: rewrites.aps_heading(c, F.lit("agu")), "end @\n[1] A\n[2] B\n[3] C\n[4] D\n[5] E", "end @\n[1] A\n[2] B\n[3] C\n[4] D\n[5] E"),
    ("resplit", lambda c: joined(rewrites.resplit(c, F.lit("aps"))), "[1] A. One, 1 (1990). [2] B. Two @", "[1] A. One, 1 (1990).|[2] B. Two @"),
    ("entries", lambda c: joined(references.entries(c)), "1. A one (1990)\ngoes on\n2. B two @", "1. A one (1990) goes on|2. B two @"),
    ("gaps", lambda c: joined(F.transform(references.missing_numbers(references.entries(c)), lambda n: n.cast("string"))), "1. A x\n2. B x\n5. C @", "3|4"),
    ("preserved", lambda c: references.preserved(F.lit("alpha beta gamma"), c).cast("string"), "gamma ## References beta", "true"),
    ("lost", lambda c: references.preserved(F.lit("alpha beta gamma"), c).cast("string"), "delta word @", "false"),
]


def literal(value: str | None) -> str:
    """A text as SQL for both engines, ``@`` as the document's id."""
    if value is None:
        return "cast(null as varchar)"
    own = value.replace("'", "''").replace("\\", "' || chr(92) || '").replace("\n", "' || chr(10) || '")
    return f"replace('{own}', '@', cast(doc_id as varchar))"


@query("select doc_id, c.name, c.result from documents, lateral (values " + ", ".join(f"('{name}', {literal(out)})" for name, _, _, out in CASES) + ") c(name, result)")
def function_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function of the table on a text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    own = F.col("doc_id").cast("string")
    given = lambda value: F.replace(F.lit(value), F.lit("@"), own)
    rows = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), given(value).alias("t")) for name, _, value, _ in CASES))).alias("c")).select("doc_id", "c.name", "c.t")
    result = None
    for name, f, _, _ in CASES:
        result = F.when(F.col("name") == name, f(F.col("t"))) if result is None else result.when(F.col("name") == name, f(F.col("t")))
    return rows.select("doc_id", "name", result.alias("result"))
