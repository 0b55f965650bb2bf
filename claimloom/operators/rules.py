"""Declarative, dated rules over all cases at once.

Predicates are builders from tables to (case_id, determination, detail, vars); a rule names one with parameters. The grid of cases and
rules is bounded by the rule set, which is small, so it is a broadcast product. A check that yields no row is a visible
NOT_DETERMINABLE, never a pass.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.money import format_indian
from claimloom.functions.text import rendered
from claimloom.model import DETERMINATION_RANK, DISPOSITIONS, EQUITABLE, MACHINE_CERTAIN, SEVERITIES, STATUS_RANK, TIER_CEILING, UNKNOWN, mapped, rank
from claimloom.operators.claims import SET, ownership_only, resolve
from claimloom.operators.verify import checked

# -- fixed values: the rule catalogue ---------------------------------------------------
# rule_id, title, category, severity, determinacy, check, params, applicability, citations, message
RULES: tuple[dict, ...] = (
    {"rule_id": "DOC_COMPLETENESS_001", "title": "Expected collateral documents received", "category": "completeness", "severity": "MEDIUM", "determinacy": "DETERMINISTIC", "check": "documents_present", "message": "Missing expected document(s): {detail}"},
    {"rule_id": "XDOC_AREA_001", "title": "Property area consistent across documents", "category": "cross_document", "severity": "HIGH", "determinacy": "DETERMINISTIC", "check": "claim_consistency", "params": {"attribute": "property.area", "tolerance_pct": 2}, "message": "Property area: {detail}"},
    {"rule_id": "XDOC_PARCEL_001", "title": "Parcel identifier consistent across documents", "category": "cross_document", "severity": "HIGH", "determinacy": "DETERMINISTIC", "check": "claim_consistency", "params": {"attribute": "property.parcel_identifier"}, "message": "Parcel identifier: {detail}"},
    {"rule_id": "OWNERSHIP_001", "title": "Ownership established by a title-transferring instrument", "category": "title", "severity": "CRITICAL", "determinacy": "DETERMINISTIC", "check": "ownership_established", "params": {"attribute": "party.owner"}, "citations": ["REQ_TPA_54_CONTRACT_CREATES_NO_INTEREST", "REQ_TPA_54_SALE_BY_REGISTERED_INSTRUMENT"], "message": "Ownership: {detail}"},
    {"rule_id": "MORTGAGE_REG_001", "title": "Mortgage registration, where required", "category": "security", "severity": "HIGH", "determinacy": "DETERMINISTIC", "check": "mortgage_registration_required", "citations": ["REQ_TPA_59_MORTGAGE_BY_REGISTERED_INSTRUMENT", "REQ_TPA_58F_MORTGAGE_BY_DEPOSIT_OF_TITLE_DEEDS"], "message": "Security type {detail}: registered instrument required but not evidenced."},
    {"rule_id": "CUSTODY_001", "title": "Original title documents held by the lender", "category": "security", "severity": "HIGH", "determinacy": "DETERMINISTIC", "check": "originals_held", "params": {"document_types": ["sale_deed"]}, "applicability": {"security_types": [EQUITABLE]}, "citations": ["REQ_TPA_58F_MORTGAGE_BY_DEPOSIT_OF_TITLE_DEEDS"], "message": "Originals not held: {detail}"},
    {"rule_id": "LTV_CAP_001", "title": "LTV within the regulatory cap for the loan slab", "category": "ltv", "severity": "CRITICAL", "determinacy": "DETERMINISTIC", "check": "ltv_within_cap", "params": {"slabs": [[3_000_000, 90], [7_500_000, 80], [None, 75]]}, "applicability": {"lender_types": ["HFC"], "products": ["housing_loan"]}, "citations": ["REQ_HFC_19_1_LTV_CAP", "REQ_HFC_19_1_LTV_COMPUTATION"], "message": "LTV above its cap: {detail}"},
    {"rule_id": "EXT_CERSAI_CHARGE_001", "title": "No prior registered charge over the collateral", "category": "external_verification", "severity": "CRITICAL", "determinacy": "EXTERNAL_VERIFIED", "check": "external_record_presence", "params": {"source_id": "SRC_CERSAI", "attribute": "property.encumbrance", "presence_means": "adverse"}, "citations": ["REQ_SARFAESI_26C_PUBLIC_NOTICE_AND_PRIORITY", "REQ_SARFAESI_26E_PRIORITY_TO_SECURED_CREDITORS"], "message": "A charge is registered against this property: {detail}"},
    {"rule_id": "EXT_OWNER_MATCH_001", "title": "Owner matches the authoritative land record", "category": "external_verification", "severity": "HIGH", "determinacy": "EXTERNAL_VERIFIED", "check": "external_agreement", "params": {"attribute": "party.owner"}, "message": "Owner does not match the record: {detail}"},
    {"rule_id": "EXT_AREA_MATCH_001", "title": "Property area matches the authoritative record", "category": "external_verification", "severity": "MEDIUM", "determinacy": "EXTERNAL_VERIFIED", "check": "external_agreement", "params": {"attribute": "property.area"}, "message": "Area does not match the record: {detail}"},
    {"rule_id": "EXT_COVERAGE_001", "title": "External verification coverage", "category": "completeness", "severity": "MEDIUM", "determinacy": "DETERMINISTIC", "check": "verification_coverage", "message": "Only some in-scope external checks were answered: {detail}"},
    {"rule_id": "LTV_CONSIDERATION_001", "title": "LTV property value not above documented transaction value", "category": "ltv", "severity": "HIGH", "determinacy": "DETERMINISTIC", "check": "ltv_value_not_above_documented_consideration", "params": {"attribute": "transaction.consideration"}, "applicability": {"lender_types": ["HFC"]}, "citations": ["REQ_HFC_AXIV_1_9_VALUE_NOT_ABOVE_DOCUMENTED_CONSIDERATION"], "message": "Property value for LTV exceeds the documented transaction value: {detail}"},
)
ENFORCED_STATUS = "APPROVED"
STATUS_TO_DETERMINATION = {"MATCH": "MATCH", "PARTIAL_MATCH": "PARTIAL_MATCH", "MISMATCH": "MISMATCH", "NOT_FOUND_IN_SOURCE": "MISSING"}

RULE_SCHEMA = (
    "rule_id string, title string, category string, severity string, determinacy string, check string, params string, citations array<string>, status string, message string, "
    "lender_types array<string>, products array<string>, states array<string>, transaction_types array<string>, security_types array<string>, "
    "requires_all array<string>, requires_any array<string>, effective_from date, effective_to date"
)
#: Allow-lists in the order in which they are tried, with the case column they constrain.
ALLOWED = (("lender_types", "lender_type"), ("products", "product"), ("states", "state"), ("transaction_types", "transaction_type"), ("security_types", "security_type"))


def validated(rules: list[dict] | tuple[dict, ...]) -> list[dict]:
    """The rules, if ids are unique and approved ones are signed off."""
    ids = [r["rule_id"] for r in rules]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"rule ids occur twice: {twice}")
    if unsigned := [r["rule_id"] for r in rules if r.get("status") == ENFORCED_STATUS and not r.get("signed_off_by")]:
        raise ValueError(f"approved without sign-off: {unsigned}")
    for r in rules:
        builder(r["check"])
    return list(rules)


def rule_table(spark: SparkSession, rules: list[dict] | tuple[dict, ...] = RULES) -> DataFrame:
    """Rules as rows; params as JSON, empty allow-lists for no constraint."""
    rows = []
    for r in validated(rules):
        a = r.get("applicability", {})
        rows.append(
            (r["rule_id"], r["title"], r["category"], r["severity"], r["determinacy"], r["check"], json.dumps(r.get("params", {})), r.get("citations", []), r.get("status", "DRAFT"), r["message"])
            + tuple(a.get(k, []) for k in ("lender_types", "products", "states", "transaction_types", "security_types", "requires_all_documents", "requires_any_document"))
            + (a.get("effective_from"), a.get("effective_to"))
        )
    return spark.createDataFrame(rows, RULE_SCHEMA)


def why_not(present: Column, as_of: Column) -> Column:
    """Why a rule doesn't apply to a case, the first reason; null if it does."""
    reasons = [F.when(as_of < F.col("effective_from"), "not in force yet"), F.when(as_of > F.col("effective_to"), "superseded")]
    reasons += [F.when((F.size(allowed) > 0) & ~F.coalesce(F.array_contains(allowed, F.col(actual)), F.lit(False)), f"{actual} not allowed") for allowed, actual in ALLOWED]
    reasons.append(F.when(F.size(F.array_except("requires_all", present)) > 0, "required documents missing"))
    reasons.append(F.when((F.size("requires_any") > 0) & ~F.arrays_overlap("requires_any", present), "none of the alternative documents"))
    return F.coalesce(*reasons)


def applicability(cases: DataFrame, rules: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Every case with every rule, and why_not. cases: case_id, the five constrained columns, present, regulatory_as_of."""
    dated = F.coalesce(as_of if as_of is not None else F.lit(None).cast("date"), F.col("regulatory_as_of"), F.current_date())
    return cases.crossJoin(F.broadcast(rules)).withColumn("why_not", why_not(F.col("present"), dated))


def disposition(outcome: Column, severity: Column, determinacy: Column) -> Column:
    """What becomes of a finding. Partial matches are cleared; what could not be told is never a failure."""
    grave = severity.isin("CRITICAL", "HIGH")
    return (
        F.when(outcome == "NOT_APPLICABLE", "NOT_APPLICABLE")
        .when(outcome == "NOT_DETERMINABLE", F.when(grave, "REVIEW_REQUIRED").otherwise("INFORMATIONAL"))
        .when(outcome.isin("MATCH", "PARTIAL_MATCH"), "CLEARED")
        .when(determinacy.isin(*MACHINE_CERTAIN) & grave, "BLOCKER")
        .when(severity == "INFORMATIONAL", "INFORMATIONAL")
        .otherwise("REVIEW_REQUIRED")
    )


def finding_confidence(outcome: Column, determinacy: Column) -> Column:
    return F.when(outcome == "NOT_DETERMINABLE", "INSUFFICIENT").when(determinacy.isin(*MACHINE_CERTAIN), "HIGH").otherwise("MEDIUM")


# -- predicates ---------------------------------------------------------------------------
# A builder takes (tables, params) and returns case_id, determination, detail for cases it can speak about.
# tables: cases, documents, claims, resolutions, verification; resolutions are computed once and shared.

Builder = Callable[[dict[str, DataFrame], dict], DataFrame]
_BUILDERS: dict[str, Builder] = {}


def predicate(name: str) -> Callable[[Builder], Builder]:
    """Registers a builder; a name can be taken once."""

    def register(f: Builder) -> Builder:
        if name in _BUILDERS:
            raise ValueError(f"predicate {name} is registered already")
        _BUILDERS[name] = f
        return f

    return register


def builder(name: str) -> Builder:
    if name not in _BUILDERS:
        raise KeyError(f"no predicate {name}; there are {sorted(_BUILDERS)}")
    return _BUILDERS[name]


def _row(outcome: Column, detail: Column, **values: Column) -> list[Column]:
    """case_id, determination, detail and vars, what a rule's message may name besides {detail}."""
    named = [x for k, v in values.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]
    return [F.col("case_id"), outcome.alias("determination"), detail.cast("string").alias("detail"), F.create_map(*named).cast("map<string,string>").alias("vars")]


@predicate("documents_present")
def documents_present(tables: dict[str, DataFrame], params: dict) -> DataFrame:
    """Expected documents: none expected is not determinable; else MATCH, or MISSING with the names."""
    expected = F.array(*map(F.lit, params["document_types"])) if params.get("document_types") else F.col("expected_documents")
    missing = F.array_sort(F.array_except(expected, F.col("present")))
    outcome = F.when(F.coalesce(F.size(expected), F.lit(0)) <= 0, "NOT_DETERMINABLE").when(F.size(missing) == 0, "MATCH").otherwise("MISSING")
    return tables["cases"].select(*_row(outcome, F.array_join(missing, ", "), missing=F.array_join(missing, ", "), expected_count=F.size(expected)))


def _worst(resolutions: DataFrame) -> DataFrame:
    """Per case, the determination that comes first in the rank order, of the first subject among equals."""
    order = F.struct(rank(F.col("determination"), DETERMINATION_RANK), F.col("subject_id"))
    return resolutions.groupBy("case_id").agg(F.min_by(F.struct("determination", "n_claims", "n_clusters", "dissent", "value"), order).alias("w"))


@predicate("claim_consistency")
def claim_consistency(tables: dict[str, DataFrame], params: dict) -> DataFrame:
    """What the claims of an attribute establish; the worst of a case's subjects. Without claims MISSING."""
    pct = params.get("tolerance_pct", 2)
    held = tables["resolutions"] if pct == 2 else resolve(tables["claims"], pct=pct)
    worst = _worst(held.where(F.col("attribute") == params["attribute"]))
    out = tables["cases"].select("case_id").join(worst, "case_id", "left")
    detail = F.concat_ws(" ", F.coalesce("w.n_clusters", F.lit(0)), F.lit("readings of"), F.coalesce("w.n_claims", F.lit(0)), F.lit("claims"))
    return out.select(*_row(F.coalesce("w.determination", F.lit("MISSING")), detail, attribute=F.lit(params["attribute"]), rationale=detail, conflicts=F.coalesce("w.dissent", F.lit(0))))


@predicate("ownership_established")
def ownership_established(tables: dict[str, DataFrame], params: dict) -> DataFrame:
    """The first subject whose owner rests on an instrument that can establish ownership; else MISSING."""
    attribute = params.get("attribute", "party.owner")
    owned = resolve(ownership_only(tables["claims"].where(F.col("attribute") == attribute)))
    first = owned.groupBy("case_id").agg(F.min_by("determination", "subject_id").alias("d"))
    weak = tables["claims"].where(F.col("attribute") == attribute).groupBy("case_id").agg(F.count("*").alias("weak"))
    out = tables["cases"].select("case_id").join(first, "case_id", "left").join(weak, "case_id", "left")
    note = F.when(F.col("d").isNull() & (F.col("weak") > 0), "only instruments that create no interest").otherwise(F.coalesce("d", F.lit("no owner claimed")))
    return out.select(*_row(F.coalesce("d", F.lit("MISSING")), note, rationale=note))


@predicate("mortgage_registration_required")
def mortgage_registration_required(tables: dict[str, DataFrame], params: dict) -> DataFrame:
    """Unknown security is not determinable; a deposit of title deeds needs none; else a mortgage deed must be there."""
    held = F.array_contains("present", "mortgage_deed")
    outcome = F.when(F.col("security_type").isNull() | (F.col("security_type") == UNKNOWN), "NOT_DETERMINABLE").when(F.col("security_type") == EQUITABLE, "NOT_APPLICABLE").when(held, "MATCH").otherwise("MISSING")
    return tables["cases"].select(*_row(outcome, F.col("security_type"), security_type=F.col("security_type")))


@predicate("originals_held")
def originals_held(tables: dict[str, DataFrame], params: dict) -> DataFrame:
    """Of each listed type the last document counts: absent is MISSING, not original MISMATCH, else MATCH."""
    types = params["document_types"]
    last = tables["documents"].where(F.col("document_type").isin(*types)).groupBy("case_id", "document_type").agg(F.max_by("custody", "ord").alias("custody"))
    seen = last.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("custody") != "original_held", F.lit(True))).alias("copies"))
    out = tables["cases"].select("case_id").join(seen, "case_id", "left")
    lacking = len(types) - F.coalesce("n", F.lit(0))
    outcome = F.when(lacking > 0, "MISSING").when(F.col("copies") > 0, "MISMATCH").otherwise("MATCH")
    return out.select(*_row(outcome, F.concat(lacking, F.lit(" absent, "), F.coalesce("copies", F.lit(0)), F.lit(" not original"))))


def _results(tables: dict[str, DataFrame], params: dict) -> DataFrame:
    """Verification results for an attribute, with the wildcard ones, maybe of one source: two equi filters, no theta join."""
    out = checked(tables["verification"]).where(F.col("attribute").isin(params["attribute"], "*"))
    return out.where(F.col("source_id") == params["source_id"]) if params.get("source_id") else out


def usable_gate() -> Column:
    """Why external results say nothing, from n, scoped_out, answered, able; null if they do."""
    return (
        F.when(F.coalesce("n", F.lit(0)) == 0, "NOT_DETERMINABLE")
        .when((F.col("scoped_out") > 0) & (F.col("answered") == 0), "NOT_APPLICABLE")
        .when((F.col("answered") == 0) | (F.col("able") == 0), "NOT_DETERMINABLE")
    )


@predicate("external_agreement")
def external_agreement(tables: dict[str, DataFrame], params: dict) -> DataFrame:
    """The worst answer of the sources, unless nothing usable came back."""
    able = F.col("counts") & (mapped(F.col("tier"), TIER_CEILING, "INSUFFICIENT") != "INSUFFICIENT")
    grouped = _results(tables, params).groupBy("case_id").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("attribute") == "*") & (F.col("status") == "NOT_APPLICABLE")).alias("scoped_out"),
        F.count_if("counts").alias("answered"),
        F.count_if(able).alias("able"),
        F.min_by(F.struct("status", "source_id", "external_value"), F.when(F.col("counts"), F.struct(rank(F.col("status"), STATUS_RANK), "source_id"))).alias("w"),
    ).withColumn("worst", F.when(F.col("answered") > 0, F.col("w.status")))
    out = tables["cases"].select("case_id").join(grouped, "case_id", "left")
    return out.select(*_row(F.coalesce(usable_gate(), mapped(F.col("worst"), STATUS_TO_DETERMINATION, "NOT_DETERMINABLE")), F.col("worst"), attribute=F.lit(params["attribute"]), source=F.col("w.source_id"), external=F.coalesce("w.external_value", F.lit("(none)"))))


@predicate("external_record_presence")
def external_record_presence(tables: dict[str, DataFrame], params: dict) -> DataFrame:
    """Whether a register holds a record at all; whatever has an external value is one."""
    grouped = _results(tables, params).groupBy("case_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(F.col("external_value") != "", F.lit(False))).alias("records"),
        F.count_if(F.col("status") == "NOT_FOUND_IN_SOURCE").alias("absent"),
        F.min("source_id").alias("source"),
        F.min(F.nullif("external_value", F.lit(""))).alias("external"),
        F.count_if((F.col("attribute") == "*") & (F.col("status") == "NOT_APPLICABLE")).alias("scoped_out"),
    )
    out = tables["cases"].select("case_id").join(grouped, "case_id", "left")
    there = F.col("records") > 0
    answer = F.when(there, "MATCH").otherwise("MISSING") if params.get("presence_means", "adverse") == "expected" else F.when(there, "MISMATCH").otherwise("MATCH")
    silent = (F.col("records") == 0) & (F.col("absent") == 0)
    outcome = F.when(F.coalesce("n", F.lit(0)) == 0, "NOT_DETERMINABLE").when(silent & (F.col("scoped_out") > 0), "NOT_APPLICABLE").when(silent, "NOT_DETERMINABLE").otherwise(answer)
    return out.select(*_row(outcome, F.concat(F.coalesce("records", F.lit(0)), F.lit(" records")), attribute=F.lit(params["attribute"]), source=F.col("source"), external=F.coalesce("external", F.lit("(no record)"))))


@predicate("verification_coverage")
def verification_coverage(tables: dict[str, DataFrame], params: dict) -> DataFrame:
    """How many in-scope checks were answered: completeness, apart from passing."""
    grouped = checked(tables["verification"]).groupBy("case_id").agg(F.count("*").alias("n"), F.count_if("counts").alias("answered"), F.count_if(F.col("status") != "NOT_APPLICABLE").alias("in_scope"), F.count_if(F.col("status") == "PENDING_MANUAL").alias("pending"), F.count_if(F.col("status") == "SOURCE_UNAVAILABLE").alias("unavailable"))
    out = tables["cases"].select("case_id").join(grouped, "case_id", "left")
    outcome = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "NOT_DETERMINABLE").when(F.col("in_scope") == 0, "NOT_APPLICABLE").when(F.col("answered") == 0, "NOT_DETERMINABLE").when(F.col("answered") == F.col("in_scope"), "MATCH").otherwise("PARTIAL_MATCH")
    )
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("answered", "in_scope", "pending", "unavailable")}
    return out.select(*_row(outcome, F.concat(counts["answered"], F.lit(" of "), counts["in_scope"]), **counts))


def slab_cap(amount_paise: Column, slabs: list[list]) -> Column:
    """The LTV cap in percent of the first slab that an amount fits; upper bounds belong to the slab."""
    out = F.lit(None).cast("int")
    for most, cap in reversed(slabs):
        out = F.lit(cap) if most is None else F.when(amount_paise <= most * 100, cap).otherwise(out)
    return out


def rupees(paise: Column) -> Column:
    """Whole rupees of an amount, as people read them."""
    return F.concat(F.lit("Rs. "), format_indian((paise / 100).cast("long")))


def ltv_percent(numerator: Column, value: Column) -> Column:
    """Loan to value in percent, two places, half to even."""
    return F.bround(F.try_divide(numerator.cast("decimal(20,0)") * 100, value.cast("decimal(20,0)")), 2)


def within_cap(numerator: Column, value: Column, cap: Column) -> Column:
    """LTV against its cap, multiplied out; not determinable without amounts or slab."""
    known = numerator.isNotNull() & (value > 0) & cap.isNotNull()
    return F.when(~F.coalesce(known, F.lit(False)), "NOT_DETERMINABLE").when(ltv_percent(numerator, value) <= cap, "MATCH").otherwise("MISMATCH")


@predicate("ltv_within_cap")
def ltv_within_cap(tables: dict[str, DataFrame], params: dict) -> DataFrame:
    """Loan to value against the cap of the loan's slab; the numerator is the outstanding amount where known."""
    numerator = F.coalesce("outstanding_paise", "sanctioned_paise")
    cap = slab_cap(numerator, params["slabs"])
    return tables["cases"].select(*_row(within_cap(numerator, F.col("property_value_paise"), cap), F.concat_ws(" of ", numerator, "property_value_paise"), ltv=ltv_percent(numerator, F.col("property_value_paise")), cap=cap, amount=rupees(numerator)))


def documented_cap(transaction: Column, value: Column, resolution: Column, documented: Column) -> Column:
    """The property value against what the documents say was paid."""
    return (
        F.when(transaction.isNull() | (transaction == "unknown"), "NOT_DETERMINABLE")
        .when(transaction == "loan_against_owned_property", "NOT_APPLICABLE")
        .when(value.isNull() | resolution.isNull() | resolution.isin("MISSING", "MISMATCH") | documented.isNull(), "NOT_DETERMINABLE")
        .when(value <= documented, "MATCH")
        .otherwise("MISMATCH")
    )


@predicate("ltv_value_not_above_documented_consideration")
def ltv_value_not_above_documented_consideration(tables: dict[str, DataFrame], params: dict) -> DataFrame:
    """The first subject's documented consideration bounds the value that LTV is computed from."""
    held = tables["resolutions"].where(F.col("attribute") == params["attribute"]).groupBy("case_id").agg(F.min_by(F.struct("determination", "value"), "subject_id").alias("r"))
    out = tables["cases"].join(held, "case_id", "left")
    documented = F.col("r.value").try_cast("bigint")
    return out.select(*_row(documented_cap(F.col("transaction_type"), F.col("property_value_paise"), F.col("r.determination"), documented), F.concat_ws(" against ", "property_value_paise", documented), value=rupees(F.col("property_value_paise")), documented=rupees(documented)))


# -- evaluation -----------------------------------------------------------------------------


def with_resolutions(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables with resolutions of all claims, if they are not given."""
    return tables if "resolutions" in tables else tables | {"resolutions": resolve(tables["claims"])}


def _answer(checks: DataFrame, no: int) -> DataFrame:
    """One plan's answers under names with its number: the case, determination, detail and vars."""
    vars_ = F.col("vars") if "vars" in checks.columns else F.create_map().cast("map<string,string>")
    return checks.select(F.col("case_id").alias(f"of_{no}_"), F.col("determination").alias(f"d_{no}_"), F.col("detail").cast("string").alias(f"t_{no}_"), vars_.alias(f"v_{no}_"))


def evaluate(tables: dict[str, DataFrame], rules: list[dict] | tuple[dict, ...] = RULES, enforce: bool = False, as_of: Column | None = None) -> DataFrame:
    """Findings: a row for each case (of which cases holds one row) and rule.

    enforce runs approved rules alone; otherwise all run and findings are advisory. Rules that share a check and parameters
    share its plan. An adverse finding's message is its rule's template, filled with what the check tells; where it names
    something that the check doesn't tell, the detail stands instead.
    """
    spark = tables["cases"].sparkSession
    kept = [r for r in validated(rules) if not enforce or r.get("status") == ENFORCED_STATUS]
    tables = with_resolutions(tables)
    plans = list(dict.fromkeys((r["check"], json.dumps(r.get("params", {}))) for r in kept))
    cases = tables["cases"]
    for no, (check, params) in enumerate(plans):
        # a row for each case, wider by an answer: all joins are on case_id, before cases meet the rules
        told = _answer(builder(check)(tables, json.loads(params)), no)
        cases = cases.join(told, F.col("case_id") == F.col(f"of_{no}_"), "left").drop(f"of_{no}_")
    grid = applicability(cases, rule_table(spark, kept) if kept else spark.createDataFrame([], RULE_SCHEMA), as_of)
    plan_of = {r["rule_id"]: plans.index((r["check"], json.dumps(r.get("params", {})))) for r in kept}

    def told_by(prefix: str, kind: str) -> Column:
        """The answer of the rule's own plan."""
        out = F.lit(None).cast(kind)
        for rule_id, no in plan_of.items():
            out = F.when(F.col("rule_id") == rule_id, F.col(f"{prefix}_{no}_")).otherwise(out)
        return out

    met = grid.withColumns({"determination": told_by("d", "string"), "detail": told_by("t", "string"), "vars": F.coalesce(told_by("v", "map<string,string>"), F.create_map().cast("map<string,string>"))})
    outcome = F.when(F.col("why_not").isNotNull(), "NOT_APPLICABLE").otherwise(F.coalesce("determination", F.lit("NOT_DETERMINABLE")))
    detail = F.coalesce(F.col("why_not"), F.col("detail"), F.lit("the check could not be completed; this is not a pass"))
    found = met.select("case_id", "rule_id", "title", "category", "severity", "determinacy", "citations", "message", outcome.alias("determination"), detail.alias("detail"), "vars", F.lit(not enforce).alias("advisory"))
    adverse = F.col("determination").isin("MISMATCH", "MISSING")
    known = F.map_zip_with("vars", F.create_map(F.lit("detail"), F.col("detail")), lambda _, own, given: F.coalesce(own, given))
    filled = F.lit(None).cast("string")
    for r in kept:
        filled = F.when(F.col("rule_id") == r["rule_id"], rendered(r["message"], known)).otherwise(filled)
    message = F.when(adverse, F.coalesce(filled, "detail", "title")).otherwise(F.col("detail"))
    found = found.withColumns({"disposition": disposition(F.col("determination"), F.col("severity"), F.col("determinacy")), "confidence": finding_confidence(F.col("determination"), F.col("determinacy")), "message": message})
    return found.withColumn("regulatory", F.size("citations") > 0).drop("vars")


def finding_order() -> list[Column]:
    """Findings, the gravest first."""
    return [rank(F.col("disposition"), DISPOSITIONS), rank(F.col("severity"), SEVERITIES), F.col("rule_id")]


def summarise(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts of findings in one pass. not_determinable overlaps the dispositions."""
    is_ = lambda d: F.count_if(F.col("disposition") == d)
    return findings.groupBy(*keys).agg(
        F.count("*").alias("total"),
        is_("BLOCKER").alias("blockers"),
        is_("REVIEW_REQUIRED").alias("review_required"),
        is_("CLEARED").alias("cleared"),
        is_("INFORMATIONAL").alias("informational"),
        is_("NOT_APPLICABLE").alias("not_applicable"),
        F.count_if(F.col("determination") == "NOT_DETERMINABLE").alias("not_determinable"),
        F.count_if(F.size("citations") > 0).alias("regulatory"),
        F.count_if(F.size("citations") == 0).alias("business"),
        F.count_if("advisory").alias("advisory"),
    )


__all__ = ["RULES", "SET", "applicability", "builder", "disposition", "evaluate", "finding_order", "predicate", "rule_table", "summarise", "validated"]
