"""What a text refers to against what it contains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.captions import is_table_image, table_id
from ..functions.rules import FIGURE_ID, TABLE_ID
from ..functions.text import all_matches

FIGURE_REF = rf"(?i)(?<![\w-])(?:Extended\s+Data\s+)?(?:Figure|Fig\.?)\s+({FIGURE_ID})"
TABLE_REF = rf"(?i)(?<![\w-])(?:Supplementary\s+|Supplement(?:ary)?\s+|Supp\.\s+)?Table\s+({TABLE_ID})"
STRICT_TABLE_REF = r"(?<![\w-])(?:(?i:Supplementary|Supplement|Supp\.)\s+)?(?i:Table)\s+((?:S?\d+|S?[IVXLC]+|[A-Z]\d+|[A-Z]\.\d+))\b"
IMAGE_LINE = r"(?md)^\s*!\[[^\]]*\]\(([^)]+)\)\s*$"
TABLE_CAPTION = rf"(?imd)^\s*\**\s*Table\s+({TABLE_ID})\b\s*[:.*|]"
SIDECAR = rf"(?iu)\[Table\s+({TABLE_ID})\s+[-—]\s+separate\s+markdown\]"


def has_supplement(stem: Column, stems: Column) -> Column:
    """Whether one of the sibling stems is this one's supplement; a supplement has none itself."""
    own = stem.rlike("(_sm|_SI|_si)$") | stem.startswith("si_")
    return ~own & F.arrays_overlap(stems, F.array(*(F.concat(stem, F.lit(x)) for x in ("_sm", "_SI", "_si")), F.concat(F.lit("si_"), stem)))


def audited(docs: DataFrame, body: str = "body", supplement: Column | None = None, strict_ids: bool = False) -> DataFrame:
    """``docs`` with referenced and inserted figures and tables and two mismatch flags.

    Ids that begin with S don't count where ``supplement`` is true: they are in another document.
    """
    elsewhere = F.lit(False) if supplement is None else supplement
    text = F.coalesce(F.col(body), F.lit(""))
    ids = lambda pattern: F.array_sort(F.array_distinct(all_matches(text, pattern)))
    here = lambda found: F.when(elsewhere, F.filter(found, lambda x: ~x.rlike("(?i)^s"))).otherwise(found)
    canonical = lambda found: F.size(F.array_distinct(F.transform(found, table_id)))
    inserted = F.array_sort(F.array_union(all_matches(text, TABLE_CAPTION), all_matches(text, SIDECAR)))
    out = docs.withColumns(
        {
            "figures_referenced": here(ids(FIGURE_REF)),
            "figures_inserted": F.size(F.filter(all_matches(text, IMAGE_LINE), lambda p: ~is_table_image(p))),
            "tables_referenced": here(ids(STRICT_TABLE_REF if strict_ids else TABLE_REF)),
            "tables_inserted": inserted,
        }
    )
    return out.withColumns({"figure_mismatch": F.size("figures_referenced") > F.col("figures_inserted"), "table_mismatch": canonical(F.col("tables_referenced")) > canonical(F.col("tables_inserted"))})
