"""Areas: number, unit and measurement basis; exact decimal square metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.binding import let
from claimloom.model import SQ_M_PER_UNIT

# -- fixed values -----------------------------------------------------------------------
UNIT_PATTERNS = (
    (r"sq\.?\s*(?:ft|feet|foot)\.?", "SQ_FT"),
    (r"square\s+(?:ft|feet|foot)", "SQ_FT"),
    (r"sq\.?\s*(?:mtrs?|meters?|metres?|m)\.?", "SQ_M"),
    (r"square\s+(?:meters?|metres?)", "SQ_M"),
    (r"sq\.?\s*(?:yds?|yards?)\.?", "SQ_YARD"),
    (r"gunthas?", "GUNTHA"),
    (r"acres?", "ACRE"),
    (r"hectares?|ha\b", "HECTARE"),
)
BASIS_PATTERNS = ((r"(?i)\bcarpet\b", "carpet"), (r"(?i)\bbuilt[\s\-]?up\b", "built_up"), (r"(?i)\bsuper\s+built[\s\-]?up\b", "super_built_up"), (r"(?i)\bplot\b|\bland\b", "plot"))
AREA = r"(?i)([\d,]+(?:\.\d+)?)\s*(" + "|".join(p for p, _ in UNIT_PATTERNS) + ")"
TOLERANCE_PCT = 2


def sq_m(value: Column, unit: Column) -> Column:
    """Square metres, six decimals, half-even."""
    factor = F.try_element_at(F.create_map(*(x for u, f in SQ_M_PER_UNIT.items() for x in (F.lit(u), F.lit(f).cast("decimal(20,10)")))), unit)
    return F.bround(value.cast("decimal(17,6)") * factor, 6).cast("decimal(28,6)")


def within_tolerance(a: Column, b: Column, pct: float | Column = TOLERANCE_PCT) -> Column:
    """Equal, or apart by at most pct percent of the larger; multiplied out, so nothing is rounded."""
    pct = pct if isinstance(pct, Column) else F.lit(pct)
    return (a == b) | (F.abs(a - b) * 100 <= F.greatest(a, b) * pct)


def basis_of(prefix: Column) -> Column:
    """The measurement basis that a text names; later patterns win."""
    out = F.lit("unspecified")
    for pattern, name in BASIS_PATTERNS:
        out = F.when(prefix.rlike(pattern), name).otherwise(out)
    return out


def unit_of(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, unit in reversed(UNIT_PATTERNS):
        out = F.when(text.rlike(f"(?i)^(?:{pattern})$"), unit).otherwise(out)
    return out


def parse_area(text: Column) -> Column:
    """The first area: raw, value, unit, sq_m, basis (named before the number); null if there is none or it is not positive."""
    value = F.regexp_replace(F.regexp_extract(text, AREA, 1), ",", "").try_cast("decimal(17,6)")
    parts = F.struct(F.regexp_extract(text, AREA, 0).alias("raw"), value.alias("value"), unit_of(F.regexp_extract(text, AREA, 2)).alias("unit"))

    def read(p: Column) -> Column:
        prefix = F.call_function("substring_index", text, p["raw"], F.lit(1))
        made = F.struct(F.trim(p["raw"]).alias("raw"), p["value"].alias("value"), p["unit"].alias("unit"), sq_m(p["value"], p["unit"]).alias("sq_m"), basis_of(prefix).alias("basis"))
        return F.when((p["raw"] != "") & (p["value"] > 0) & p["unit"].isNotNull(), made)

    return let(parts, read)
