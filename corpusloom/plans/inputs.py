"""Made-up inputs, as SQL that both engines read."""

NL = "chr(10)"


def case(column: str, *values: str) -> str:
    """SQL that picks a literal by remainder."""
    whens = " ".join(f"when {k} then {v}" for k, v in enumerate(values))
    return f"(case {column} % {len(values)} {whens} end)"


#: Body texts with references to figures and tables, images, captions and sidecars.
AUDIT = f"""
select doc_id,
  case when doc_id % 3 = 0 then '---' || {NL} || 'note: Fig. 9 and Table 9' || {NL} || '---' || {NL} else '' end
  || '# Paper ' || cast(doc_id as string) || {NL} || {NL}
  || 'See Fig. ' || cast(doc_id % 4 + 1 as string) || ' and Figure S' || cast(doc_id % 3 + 1 as string) || '. Compare '
  || {case("doc_id", "'Table IV'", "'Table 4'", "'Supplementary Table S2'", "'table columns'", "'no tables'", "'Extended Data Fig. 3'", "'Table A.1 and Table V and Table 5'")}
  || '.' || {NL} || {NL} || coalesce(text, '') || {NL} || {NL}
  || case when doc_id % 2 = 0 then '![one](assets/figure_1.jpg)' || {NL} else '' end
  || case when doc_id % 5 < 3 then '![two](assets/deep/Figure_2.png)' || {NL} else '' end
  || case when doc_id % 7 = 1 then '![t](assets/table_p1_1.jpg)' || {NL} else '' end
  || case when doc_id % 4 = 1 then '**Table 4.** Values' || {NL} else '' end
  || case when doc_id % 4 = 2 then '[Table V — separate markdown](assets/t.md)' || {NL} else '' end as md
from {{docs}}"""

#: First pages with DOIs and arXiv ids.
FRONT_PAGES = f"""
select doc_id, 'Vol. 1 ' || {case("doc_id", "'doi:10.1103/PhysRevLett.12.' || cast(doc_id as string) || '.'", "'see 10.1029/2019JE1234 and https://doi.org/10.1016/j.icarus.2020.' || cast(doc_id as string) || ')'", "'10.5555/placeholder'", "'10.1038/s41561-020-' || cast(doc_id as string) || ','", "'no identifier'", "'arXiv:1901.0' || cast(1000 + doc_id % 9000 as string) || 'v2'", "'10.1126/sciadv.abc' || cast(doc_id as string)", "'10.9999/unknown.' || cast(doc_id as string)", "'10.1038/nature1' || cast(doc_id as string)", "'10.1103/PhysRevX.1.' || cast(doc_id as string)")}
  || ' ' || coalesce(text, '') as page from {{docs}}"""

#: Licences as services and pages write them.
LICENCES = f"""
select doc_id, {case("doc_id", "'https://creativecommons.org/licenses/by/4.0/'", "'CC-BY-NC-4.0'", "'https://creativecommons.org/licenses/by-nc-sa/3.0/legalcode'", "'  PD '", "'arxiv'", "'https://arxiv.org/licenses/nonexclusive-distrib/1.0/'", "'https://creativecommons.org/publicdomain/zero/1.0/'", "'MIT'", "'publisher-specific'", "''", "'https://www.elsevier.com/x/tdm'", "'green-oa-no-license'", "'cc-by-nd'", "cast(null as string)", "'http://creativecommons.org/licenses/by-nc-nd/'")} as raw from {{docs}}"""

#: Texts that name deposits, in and out of availability sections.
DEPOSITS = f"""
select doc_id, '# Title' || {NL} || 'Data at https://zenodo.org/records/' || cast(1000 + doc_id % 50 as string) || '.' || {NL}
  || {case("doc_id", "'## Data Availability' || chr(10) || 'Deposited as 10.5281/zenodo.' || cast(1000 + doc_id % 50 as string) || ' and 10.5061/dryad.ab' || cast(doc_id as string) || '.'", "'**Code availability**' || chr(10) || 'https://osf.io/abc' || cast(10 + doc_id % 80 as string) || '/ holds all.'", "'## Methods' || chr(10) || '10.17632/xyz' || cast(doc_id as string) || '.1 here'", "'plain' || chr(10) || 'https://figshare.com/articles/dataset/name/' || cast(doc_id as string)", "'## Data and Code Availability Statement:' || chr(10) || 'https://data.caltech.edu/records/' || cast(doc_id as string) || '-x'")}
  || {NL} || '## Next' || {NL} || 'See also 10.3886/ICPSR' || cast(doc_id % 7 as string) || ' here.' as md from {{docs}}"""

#: Caption texts of every form.
CAPTIONS = f"""
select doc_id, {case("doc_id", "'Figure 1 | Overview of the model runs'", "'b) Fig. 2. Second panel of the results'", "'(a)'", "'Fig. 7'", "'The upper Fig. 1.layer grows in the cell'", "'Contrac- Table 2.tion of the samples'", "'Downloaded from somewhere'", "'www.nature.com 2020'", "'Table 3. Values of all runs'", "'Notes: one and two'", "''", "'Fig. 6. First part. Fig. 7. Second part of it'", "'Figure 3, a, first thing. b, second thing'", "cast(null as string)", "'a b)'", "'Extended Data Figure 4: more than enough text'", "'Plate 12. Sky at night'", "'Body text that refers to Figure 8 in passing'")} as text from {{docs}}"""

#: Blocks of two pages for each document. Parents don't compete for the same texts.
BLOCKS = f"""
select d.doc_id, b.page_idx, b.idx, b.type, b.x0, b.y0 + d.doc_id % 7 as y0, b.x1, b.y1 + d.doc_id % 7 as y1,
  replace(b.text, '#', cast(d.doc_id % 5 + 1 as string)) as text, b.image_path,
  case when b.type = 'table' and d.doc_id % 2 = 0 then 'own note' end as footnote
from {{docs}} d cross join (values
  (0, 0, 'title', 50.0, 40.0, 560.0, 60.0, 'Title #', cast(null as string)),
  (0, 1, 'image', 60.0, 100.0, 300.0, 250.0, cast(null as string), 'i1.jpg'),
  (0, 2, 'text', 60.0, 260.0, 300.0, 285.0, 'Fig. #. Caption right below the image', cast(null as string)),
  (0, 3, 'text', 60.0, 300.0, 300.0, 340.0, 'Figure 9 shows more, far below', cast(null as string)),
  (0, 4, 'table', 60.0, 420.0, 300.0, 500.0, 'www.science.org', 't1.jpg'),
  (0, 5, 'text', 60.0, 395.0, 300.0, 415.0, 'Table #. Values above the table', cast(null as string)),
  (0, 6, 'text', 60.0, 505.0, 300.0, 520.0, '* measured twice', cast(null as string)),
  (1, 0, 'image', 40.0, 80.0, 180.0, 200.0, 'a', 'p1.jpg'),
  (1, 1, 'image', 220.0, 80.0, 360.0, 200.0, '', 'p2.jpg'),
  (1, 2, 'chart', 400.0, 80.0, 560.0, 200.0, 'c Figure #. All panels of the run, a, one. b, two', 'p3.jpg'),
  (1, 3, 'image', 40.0, 300.0, 180.0, 420.0, 'Fig. #', 'p4.jpg'),
  (1, 4, 'text', 40.0, 500.0, 180.0, 620.0, 'left column text', cast(null as string)),
  (1, 5, 'text', 230.0, 500.0, 370.0, 620.0, 'middle column text', cast(null as string)),
  (1, 6, 'text', 420.0, 500.0, 560.0, 620.0, 'right column text', cast(null as string)),
  (1, 7, 'ref_text', 40.0, 640.0, 180.0, 700.0, 'reference', cast(null as string))
) as b(page_idx, idx, type, x0, y0, x1, y1, text, image_path)"""


def entries(style: str, n: int) -> str:
    """SQL for n lines of a reference list."""
    form = {"numbered": "{k}. Smith, A., Journal {k}, 10 (19{y})", "bracketed": "[{k}] A. Smith, Journal {k} (19{y})", "footnote": "{k}A. Smith, Journal {k}, 10 (19{y})", "ay": "Smith and Jones{k} (19{y}). A title of a paper"}[style]
    return "'" + "' || chr(10) || '".join(form.format(k=k, y=50 + k).replace("Jones" + str(k), "Jones") for k in range(1, n + 1)) + "'"


#: Texts with reference lists of every style, with and without a heading.
REFERENCES = f"""
select doc_id, {case("doc_id", "'numbered'", "'bracketed'", "'footnote'", "'author-year'", "'headed'", "'none'")} as made_as,
  '# Paper' || {NL} || {NL} || replace(replace(coalesce(text, ''), {NL}, ' '), '[', '(') || {NL} || {NL} || repeat('All is well in this part. ', 40) || {NL} || {NL} || {case("doc_id", entries("numbered", 8), entries("bracketed", 7), entries("footnote", 6), entries("ay", 12), "'## References' || chr(10) || " + entries("numbered", 6), "'The end.'")} || {NL} as md from {{docs}}"""

#: Texts with everything that the strippers drop.
DIRTY = f"""
select doc_id, '# Title' || {NL} || cast(doc_id % 3000 as string) || {NL} || 'SMITH ET AL. ' || cast(doc_id % 9 + 1 as string) || ' of 9' || {NL} || 'The work of Smith et al. is good' || {NL}
  || {case("doc_id", "'**LETTERS**'", "'NATURE GEOSCIENCE DOI: 10.1038/NGEO2574'", "'- NATURE GEOSCIENCE DOI: 10.1038/X in a list'", "'| LETTERS | 1 |'")} || {NL}
  || {case("doc_id", "'onlinelibrary.wiley.com/doi/10.1 by A'", "'Retrieved from http://onlinelibrary.wiley.com/x'", "'See the Terms and Conditions'")} || {NL}
  || 'Sum ' || chr(92) || 'label' || chr(123) || 'eq:1' || chr(125) || ' and ' || chr(92) || 'eqref' || chr(123) || 'eq:1' || chr(125) || {NL} || replace(coalesce(text, ''), {NL}, ' ') as md from {{docs}}"""
