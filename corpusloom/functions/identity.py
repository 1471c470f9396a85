"""DOIs, arXiv ids, journals, licences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import DOI_BLOCKED, JOURNALS, LICENCE_ALIASES, LICENCE_HOMES, LICENCE_SLUG, LICENCE_URLS, TIERS
from .text import blank_to_null, cascade, first_match

DOI = r"(?i)\b(10\.\d{4,9}/[^\s\"<>]+)"


def clean_doi(raw: Column) -> Column:
    """Lower case, without closing punctuation; placeholders are null."""
    doi = F.regexp_replace(F.lower(F.trim(raw)), r"[.,;)>\]]+$", "")
    blocked = F.lit(False)
    for prefix in DOI_BLOCKED:
        blocked = blocked | doi.startswith(prefix)
    return F.when(~blocked, doi)


def doi_in(text: Column) -> Column:
    """The first DOI of a text; one in a ``doi.org`` address goes first."""
    return clean_doi(F.coalesce(first_match(text, r"(?i)doi\.org/(10\.\d{4,9}/[^\s\"<>]+)"), first_match(text, DOI)))


def arxiv_in(text: Column) -> Column:
    return first_match(text, r"(?i)\barXiv:(\d{4}\.\d{4,5})(?:v\d+)?")


def journal(doi: Column) -> Column:
    return cascade(F.lower(F.trim(doi)), JOURNALS)


def licence(raw: Column) -> Column:
    """A licence's slug from a slug, an alias or an address; null if unknown."""
    s = F.lower(F.trim(raw))
    rules: list = [(LICENCE_SLUG, s)]
    rules += [(f"^{alias}$", slug) for alias, slug in LICENCE_ALIASES.items()]
    for pattern, slug in LICENCE_URLS:
        rules.append((pattern, F.concat(F.lit(slug), F.regexp_extract(s, pattern, 1)) if slug.endswith("-") else slug))
    return cascade(blank_to_null(s), rules)


def base_licence(slug: Column) -> Column:
    return F.regexp_replace(slug, r"-\d+\.\d+$", "")


def safety(slug: Column) -> Column:
    """Whether a text may be passed on: true, restricted, readable or false."""
    base = base_licence(slug)
    out = None
    for tier, members in TIERS.items():
        hit = base.isin(*members)
        out = F.when(hit, tier) if out is None else out.when(hit, tier)
    return out.otherwise("false")


def licence_home(slug: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in LICENCE_HOMES.items() for x in pair))
    return F.try_element_at(pairs, base_licence(slug))
