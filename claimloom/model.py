"""Vocabularies, rank orders and small dimension tables.

The values below are fixed: results depend on these names, orders and numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# -- fixed values: enumerations -------------------------------------------------------
DETERMINATIONS = ("MATCH", "PARTIAL_MATCH", "MISMATCH", "MISSING", "NOT_DETERMINABLE", "NOT_APPLICABLE")
CONFIDENCES = ("INSUFFICIENT", "LOW", "MEDIUM", "HIGH")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFORMATIONAL")
DETERMINACIES = ("DETERMINISTIC", "EXTERNAL_VERIFIED", "RETRIEVAL_ASSISTED", "MODEL_PROPOSED", "HUMAN_REQUIRED")
MACHINE_CERTAIN = ("DETERMINISTIC", "EXTERNAL_VERIFIED")
DISPOSITIONS = ("BLOCKER", "REVIEW_REQUIRED", "INFORMATIONAL", "CLEARED", "NOT_APPLICABLE")
INSTRUMENT_STRENGTHS = ("title_transferring", "contractual", "possessory", "administrative", "non_probative")
OWNERSHIP_STRENGTHS = ("title_transferring", "administrative")
TIERS = ("T1", "T2", "T3", "T4", "T5", "T6")
STATUSES = ("MATCH", "PARTIAL_MATCH", "MISMATCH", "NOT_FOUND_IN_SOURCE", "STALE", "NOT_APPLICABLE", "SOURCE_UNAVAILABLE", "PENDING_MANUAL")
OUTCOMES = ("CORRECT", "NEAR", "WRONG", "NOT_EVALUATED", "MISSING", "SPURIOUS")

# -- fixed values: orders, the first to surface first ----------------------------------
DETERMINATION_RANK = ("MISMATCH", "MISSING", "NOT_DETERMINABLE", "PARTIAL_MATCH", "MATCH", "NOT_APPLICABLE")
STATUS_RANK = ("MISMATCH", "NOT_FOUND_IN_SOURCE", "PARTIAL_MATCH", "STALE", "MATCH", "NOT_APPLICABLE", "SOURCE_UNAVAILABLE", "PENDING_MANUAL")

# -- fixed values: areas ----------------------------------------------------------------
SQ_M_PER_UNIT = {"SQ_M": "1", "SQ_FT": "0.09290304", "SQ_YARD": "0.83612736", "ACRE": "4046.8564224", "HECTARE": "10000", "GUNTHA": "101.17141056"}

# -- fixed values: what answers, how far a tier can be trusted ---------------------------
ANSWERED = ("MATCH", "PARTIAL_MATCH", "MISMATCH", "NOT_FOUND_IN_SOURCE", "STALE")
ADVERSE_STATUSES = ("MISMATCH", "NOT_FOUND_IN_SOURCE")
TIER_CEILING = {"T1": "HIGH", "T2": "HIGH", "T3": "MEDIUM", "T4": "MEDIUM", "T5": "MEDIUM", "T6": "INSUFFICIENT"}
AUTOMATABLE_TIERS, HUMAN_TIERS = ("T1", "T2", "T3"), ("T4", "T5")

# -- fixed values: documents and their instrument strength; others are non_probative -------
DOCUMENT_TYPES = (
    "agreement_of_sale", "sale_deed", "property_papers", "property_tax", "possession_document", "encumbrance_certificate",
    "mutation_record", "property_card", "title_deed", "noc", "mortgage_deed", "registration_receipt", "building_approval",
    "occupancy_certificate", "valuation_report", "unknown",
)
STRENGTH_OF_DOCUMENT = {
    "sale_deed": "title_transferring",
    "title_deed": "title_transferring",
    "mutation_record": "administrative",
    "property_card": "administrative",
    "property_tax": "administrative",
    "agreement_of_sale": "contractual",
    "possession_document": "possessory",
}
EQUITABLE, UNKNOWN = "equitable_deposit_of_title_deeds", "unknown"


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """The value's place in order, from 0; values that are not in it come last."""
    out = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        out = F.when(value == name, F.lit(i)).otherwise(out)
    return out


def named(place: Column, order: tuple[str, ...]) -> Column:
    """The value at a place of order."""
    return F.element_at(F.array(*map(F.lit, order)), place + 1)


def mapped(key: Column, values: dict[str, str], default: str | None = None) -> Column:
    """values[key], or the default; one literal map, no join."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def capped(confidence: Column, tier: Column) -> Column:
    """The lower of a confidence and what its tier allows."""
    ceiling = mapped(tier, TIER_CEILING, "INSUFFICIENT")
    return named(F.least(rank(confidence, CONFIDENCES), rank(ceiling, CONFIDENCES)), CONFIDENCES)


def establishes_ownership(strength: Column) -> Column:
    return strength.isin(*OWNERSHIP_STRENGTHS)


def requires_registered_instrument(security_type: Column) -> Column:
    """Three-valued: null where the security type is unknown."""
    return F.when(security_type != UNKNOWN, security_type != EQUITABLE)


def ltv_percent(numerator: Column, value: Column) -> Column:
    """Loan to value in percent, two decimals, half-even; null where the value is 0 or unknown."""
    ratio = F.try_divide(numerator.cast("decimal(20,0)") * 100, value.cast("decimal(20,0)"))
    return F.bround(ratio, 2).cast("decimal(20,2)")


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of fixed rows."""
    return spark.createDataFrame(rows, schema)
