"""Checks against outside sources: what to ask, with the least disclosure, and what an answer says.

Observations arrive as a table, or from adapters that a caller registers; this module reaches out to nothing. A source that did not answer never counts for or against a case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.areas import TOLERANCE_PCT, within_tolerance
from claimloom.functions.binding import let
from claimloom.functions.names import match_names
from claimloom.model import ADVERSE_STATUSES, ANSWERED, AUTOMATABLE_TIERS, capped

# -- fixed values: source, priority, tier, keys best first, vocabulary, blocks, freshness in days ---
SOURCES = (
    ("SRC_CERSAI", 1, "T2", ("property_identifiers", "borrower_identifiers"), ("existing_charges", "encumbrance", "multiple_lending_against_same_collateral"), (), 30),
    ("SRC_IGR_ESEARCH", 2, "T4", ("document_number", "year", "sro", "cts_number"), ("registration_particulars", "index_ii", "parties", "consideration", "property_description"), ("read_terms_of_use_from_indian_network",), None),
    ("SRC_MAHARERA", 3, "T4", ("maharera_registration_number", "project_name", "promoter_name", "promoter_pan", "district"), ("project_name", "promoter", "registration_number", "project_status", "phase", "registration_validity"), ("read_terms_of_use_from_indian_network", "confirm_rera_threshold"), 180),
    ("SRC_MCGM_PTAX", 4, "T4", ("property_account_number_pid", "assessment_number", "ward_name_address"), ("assessee_name", "property_address", "assessment_number", "outstanding_dues", "payment_history"), (), 90),
    ("SRC_PROPERTY_CARD_MH", 5, "T5", ("cts_number", "city_survey_office"), ("owner_of_record", "cts_number", "area", "boundaries", "encumbrance_notes"), (), 365),
)
KEY_ATTRIBUTE = {
    "cts_number": "property.parcel_identifier",
    "property_identifiers": "property.parcel_identifier",
    "maharera_registration_number": "project.rera_registration_number",
    "project_name": "project.name",
    "promoter_name": "project.promoter",
    "assessment_number": "tax.assessment_number",
    "property_account_number_pid": "tax.assessment_number",
    "document_number": "registration.number",
    "borrower_identifiers": "party.owner",
    "ward_name_address": "property.address",
    "city_survey_office": "property.locality",
    "sro": "registration.sub_registrar",
}
VERIFIED_ATTRIBUTE = {
    "project_name": "project.name",
    "promoter": "project.promoter",
    "registration_number": "registration.number",
    "project_status": "project.status",
    "phase": "project.phase",
    "registration_validity": "project.registration_validity",
    "registration_particulars": "registration.number",
    "index_ii": "registration.index_ii",
    "parties": "party.owner",
    "consideration": "transaction.consideration",
    "property_description": "property.address",
    "assessee_name": "party.assessee",
    "property_address": "property.address",
    "assessment_number": "tax.assessment_number",
    "outstanding_dues": "tax.outstanding_dues",
    "payment_history": "tax.payment_history",
    "owner_of_record": "party.owner",
    "cts_number": "property.parcel_identifier",
    "area": "property.area",
    "boundaries": "property.boundaries",
    "encumbrance_notes": "property.encumbrance",
    "existing_charges": "property.encumbrance",
    "encumbrance": "property.encumbrance",
    "multiple_lending_against_same_collateral": "property.encumbrance",
}
NAME_ATTRIBUTES = ("party.owner", "party.seller", "party.buyer", "party.assessee", "party.mortgagor", "party.mortgagee", "project.promoter")
SUPPORTED_STATES = ("MH",)
#: A source is only asked about cases for which this attribute is known.
GATES = {"SRC_MAHARERA": "project.rera_registration_number", "SRC_PROPERTY_CARD_MH": "property.parcel_identifier"}

SOURCE_SCHEMA = "source_id string, priority int, tier string, keyed_by array<string>, verifies array<string>, blocked_on array<string>, freshness_days int"


def mapped_terms(terms: list[str] | tuple[str, ...], vocabulary: dict[str, str]) -> list[str]:
    """Terms as attributes: unknown ones passed over, each once, in order."""
    return list(dict.fromkeys(vocabulary[t] for t in terms if t in vocabulary))


def worse_tier(text: str) -> str:
    """The worse of a range such as T1_OR_T2."""
    return max(part for part in text.split("_") if part[:1] == "T" and part[1:].isdigit())


def source_table(spark: SparkSession, sources=SOURCES) -> DataFrame:
    rows = [(s, p, t, list(keys), mapped_terms(terms, VERIFIED_ATTRIBUTE), list(blocked), fresh) for s, p, t, keys, terms, blocked, fresh in sources]
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def sources_for(sources: DataFrame, attribute: str) -> DataFrame:
    return sources.where(F.array_contains("verifies", attribute)).orderBy("priority")


def counts_as_check(status: Column, external: Column) -> Column:
    """Answered, or a record that there was nothing to compare with."""
    return F.coalesce(status.isin(*ANSWERED) | ((status == "NOT_APPLICABLE") & (external != "")), F.lit(False))


def checked(results: DataFrame) -> DataFrame:
    """results with counts, adverse and needs_review."""
    status = F.col("status")
    return results.withColumns({"counts": counts_as_check(status, F.col("external_value")), "adverse": status.isin(*ADVERSE_STATUSES), "needs_review": status.isin("PARTIAL_MATCH", "STALE", *ADVERSE_STATUSES)})


def is_stale(retrieved_at: Column, record_as_of: Column, freshness_days: Column) -> Column:
    """Whether a record was older than allowed when it was fetched; fresh where a date or the limit is unknown."""
    return F.coalesce(F.timestamp_diff("SECOND", record_as_of, retrieved_at) > freshness_days * 86_400, F.lit(False))


def minimal_key(keyed_by: Column, held: Column) -> Column:
    """The first key, in the source's order, whose attribute is known and undisputed; and the disputed ones before it.

    held: map of attribute -> struct(determination, value).
    """
    attribute = F.create_map(*(F.lit(x) for pair in KEY_ATTRIBUTE.items() for x in pair))
    state = F.transform(keyed_by, lambda k: F.struct(k.alias("key"), F.try_element_at(held, F.try_element_at(attribute, k)).alias("r")))
    known = F.filter(state, lambda s: s["r"].isNotNull() & (s["r"]["determination"] != "MISSING") & s["r"]["value"].isNotNull())
    at = F.array_position(F.transform(known, lambda s: s["r"]["determination"] != "MISMATCH"), F.lit(True)).cast("int")
    chosen = F.when(at > 0, F.get(known, at - 1))
    before = F.when(at > 0, F.slice(known, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(known)
    return F.struct(chosen["key"].alias("key"), chosen["r"]["value"].alias("value"), F.transform(before, lambda s: s["key"]).alias("ambiguous"))


def held_map(resolutions: DataFrame) -> DataFrame:
    """case_id and held, a map from attribute to (determination, value), of each case's first subject."""
    first = resolutions.groupBy("case_id", "attribute").agg(F.min_by(F.struct("determination", "value"), "subject_id").alias("r"))
    return first.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "r"))).alias("held"))


def plan(cases: DataFrame, resolutions: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each supported case and source: execution SKIP, MANUAL or AUTOMATED, the one key to disclose, what to ask."""
    known = cases.where(F.col("state").isin(*SUPPORTED_STATES)).select("case_id").join(held_map(resolutions), "case_id")
    grid = known.crossJoin(F.broadcast(sources)).withColumn("k", minimal_key(F.col("keyed_by"), F.col("held")))
    gate = F.lit(False)
    for source, attribute in GATES.items():
        known_here = F.coalesce(F.try_element_at("held", F.lit(attribute))["determination"] != "MISSING", F.lit(False))
        gate = gate | ((F.col("source_id") == source) & ~known_here)
    own = F.array_intersect("verifies", F.map_keys(F.map_filter("held", lambda _, r: r["determination"] != "MISSING")))
    execution = F.when(gate | F.col("k.key").isNull(), "SKIP").when(F.size("blocked_on") > 0, "MANUAL").when(F.col("tier").isin(*AUTOMATABLE_TIERS), "AUTOMATED").otherwise("MANUAL")
    reason = F.when(gate, "gate").when(F.col("k.key").isNull(), "no usable key").when(F.size("blocked_on") > 0, "blocked").otherwise("tier")
    asked = F.when(F.size(own) > 0, own).otherwise(F.col("verifies"))
    return grid.select("case_id", "source_id", "priority", "tier", "freshness_days", execution.alias("execution"), reason.alias("reason"), F.col("k.key").alias("lookup_key"), F.col("k.value").alias("lookup_value"), F.col("k.ambiguous").alias("ambiguous"), asked.alias("attributes"))


def plan_summary(planned: DataFrame) -> DataFrame:
    is_ = lambda e: F.count_if(F.col("execution") == e)
    return planned.groupBy("case_id").agg(is_("AUTOMATED").alias("automated"), is_("MANUAL").alias("manual"), is_("SKIP").alias("skipped"), F.count_if(F.col("execution") != "SKIP").alias("actionable"))


def compare_values(attribute: Column, a: Column, b: Column, pct: float = TOLERANCE_PCT) -> Column:
    """Status of an internal value against an external one, structs of kind, cmp_key, raw, sq_m and basis."""
    by_name = let(match_names(a["raw"], b["raw"])["determination"], lambda d: F.when(d == "NOT_DETERMINABLE", "NOT_FOUND_IN_SOURCE").otherwise(d))
    bases = (a["basis"] != b["basis"]) & (a["basis"] != "unspecified") & (b["basis"] != "unspecified")
    area = F.when(bases, "PARTIAL_MATCH").when(within_tolerance(a["sq_m"], b["sq_m"], pct), "MATCH").otherwise("MISMATCH")
    x, y = a["cmp_key"], b["cmp_key"]
    text = F.when(x == y, "MATCH").when((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), "PARTIAL_MATCH").otherwise("MISMATCH")
    return (
        F.when(a["kind"] != b["kind"], "MISMATCH")
        .when(attribute.isin(*NAME_ATTRIBUTES) & (a["kind"] == "text"), by_name)
        .when(a["kind"] == "area", area)
        .when(a["kind"] == "text", text)
        .otherwise(F.when(x == y, "MATCH").otherwise("MISMATCH"))
    )


def observed_status(compared: Column, record_found: Column, external: Column, internal: Column, stale: Column) -> Column:
    """What an observation says. internal: the resolution's determination. In this order: no record, no such field,
    nothing to compare with, too old, and the comparison, which can only partly confirm what is disputed internally.
    """
    return (
        F.when(~record_found, "NOT_FOUND_IN_SOURCE")
        .when(external.isNull(), "NOT_APPLICABLE")
        .when(F.coalesce(internal, F.lit("MISSING")) == "MISSING", "NOT_APPLICABLE")
        .when(stale, "STALE")
        .when((internal == "MISMATCH") & (compared == "MATCH"), "PARTIAL_MATCH")
        .otherwise(compared)
    )


def observed_confidence(status: Column, tier: Column) -> Column:
    base = F.when(status == "NOT_APPLICABLE", "INSUFFICIENT").when(status == "STALE", "LOW")
    return F.coalesce(base, capped(F.when(status == "MATCH", F.lit("HIGH")).otherwise(F.lit("MEDIUM")), tier))


def orchestrate(planned: DataFrame, observations: DataFrame, internals: DataFrame) -> DataFrame:
    """Verification results: a wildcard row for each skipped source, pending rows for manual ones, compared rows for the rest.

    observations: case_id, source_id, attribute, record_found, record_as_of, retrieved_at, external (struct).
    internals: case_id, attribute, determination, internal (struct). An automated source without an observation was
    unavailable; a manual one whose observation has arrived is compared like any other.
    """
    base = ["case_id", "source_id", "tier"]
    skipped = planned.where("execution = 'SKIP'").select(*base, F.lit("*").alias("attribute"), F.lit("NOT_APPLICABLE").alias("status"), F.lit(None).cast("string").alias("external_value"), F.lit("INSUFFICIENT").alias("confidence"))
    asked = planned.where("execution <> 'SKIP'").withColumn("attribute", F.explode("attributes"))
    met = asked.join(observations, ["case_id", "source_id", "attribute"], "left").join(internals, ["case_id", "attribute"], "left")
    stale = is_stale(F.col("retrieved_at"), F.col("record_as_of"), F.col("freshness_days"))
    compared = compare_values(F.col("attribute"), F.col("internal"), F.col("external"))
    seen = observed_status(compared, F.col("record_found"), F.col("external"), F.col("determination"), stale)
    status = F.when(F.col("record_found").isNull(), F.when(F.col("execution") == "MANUAL", "PENDING_MANUAL").otherwise("SOURCE_UNAVAILABLE")).otherwise(seen)
    done = met.withColumn("status", status)
    done = done.select(*base, "attribute", "status", F.when(F.col("record_found"), F.col("external.raw")).alias("external_value"), F.when(F.col("record_found").isNull(), "INSUFFICIENT").otherwise(observed_confidence(F.col("status"), F.col("tier"))).alias("confidence"))
    return skipped.unionByName(done)


OBSERVED = "case_id string, source_id string, attribute string, record_found boolean, record_as_of timestamp, retrieved_at timestamp, external struct<kind:string,cmp_key:string,raw:string,sq_m:decimal(28,6),basis:string>, error string"
Adapter = Callable[[str, str, str, list[str]], list[dict]]


def not_implemented(case_id: str, lookup_key: str, lookup_value: str, attributes: list[str]) -> list[dict]:
    """An adapter for a source that nothing can ask yet."""
    raise NotImplementedError("no adapter for this source")


def static_adapter(records: dict[str, dict[str, dict]]) -> Adapter:
    """An adapter that answers from records: lookup value -> attribute -> an observation's columns."""

    def ask(case_id: str, lookup_key: str, lookup_value: str, attributes: list[str]) -> list[dict]:
        held = records.get(lookup_value)
        return [{"attribute": a, "record_found": held is not None, **((held or {}).get(a) or {})} for a in attributes]

    return ask


def observed(planned: DataFrame, adapters: dict[str, Adapter]) -> DataFrame:
    """OBSERVED rows of the automated part of a plan. Only the one key of a plan's row is disclosed to its adapter.

    A source without an adapter, or one that fails, yields a row for each attribute with its error and no record_found, which
    orchestrate() reads as SOURCE_UNAVAILABLE; other rows go on.
    """
    names = [f.split()[0] for f in OBSERVED.split(", ")]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                asked = [str(a) for a in r.attributes]
                try:
                    got = adapters.get(r.source_id, not_implemented)(r.case_id, r.lookup_key, r.lookup_value, asked)
                except Exception as e:  # one source's failure is that source's rows
                    got = [{"attribute": a, "error": f"{type(e).__name__}: {e}"} for a in asked]
                rows += [{"case_id": r.case_id, "source_id": r.source_id, **g} for g in got]
            yield pd.DataFrame([[row.get(n) for n in names] for row in rows], columns=names, dtype=object)

    return planned.where("execution = 'AUTOMATED'").select("case_id", "source_id", "lookup_key", "lookup_value", "attributes").mapInPandas(of, OBSERVED)


def key_notes(planned: DataFrame) -> DataFrame:
    """case_id, source_id and note where disputed keys were passed over, or nothing else was left."""
    named = F.array_join("ambiguous", ", ")
    used = F.when(F.col("lookup_key").isNotNull(), F.concat(F.lit("; asked by "), F.col("lookup_key"))).otherwise("; nothing undisputed to ask by")
    return planned.where(F.size("ambiguous") > 0).select("case_id", "source_id", F.concat(F.lit("disputed: "), named, used).alias("note"))


def written_back(cases: DataFrame, results: DataFrame) -> DataFrame:
    """cases with verification, the counts of their results; zeros where nothing was verified."""
    counted = results_summary(results, "case_id").withColumnRenamed("case_id", "of_case_")
    names = ("total", "answered", "adverse", "needs_review")
    out = cases.join(counted, F.col("case_id") == F.col("of_case_"), "left")
    return out.select(*(F.col(c) for c in cases.columns), F.struct(*(F.coalesce(n, F.lit(0)).alias(n) for n in names)).alias("verification"))


def results_summary(results: DataFrame, *keys: str) -> DataFrame:
    rows = checked(results)
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("counts").alias("answered"), F.count_if("adverse").alias("adverse"), F.count_if("needs_review").alias("needs_review"))


def manual_tasks(planned: DataFrame) -> DataFrame:
    """Open tasks for people, the most urgent first."""
    return planned.where("execution = 'MANUAL'").select("case_id", "source_id", "priority", "lookup_key", "lookup_value", "attributes", F.lit("OPEN").alias("state")).orderBy("priority", "case_id")


#: States of a task in which someone must still act.
OPEN_STATES = ("OPEN", "IN_PROGRESS")


def task_events(tasks: DataFrame, state: str, at: Column, operator: Column, artefact: Column | None = None, note: Column | None = None) -> DataFrame:
    """Log rows that complete tasks (COMPLETED), or tell that a record couldn't be had (UNOBTAINABLE): who, what for, when."""
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    return tasks.select("task_id", F.lit(state).alias("state"), at.alias("at"), text(operator).alias("operator_id"), text(artefact).alias("artefact_ref"), text(note).alias("note"))


def task_board(tasks: DataFrame, events: DataFrame, open_only: bool = True) -> DataFrame:
    """tasks (task_id, priority, created_at, ...) with their latest state from the log, OPEN before any; the most urgent first."""
    last = task_states(events).select(F.col("task_id").alias("of_task_"), F.col("state").alias("state"), F.col("at").alias("changed_at"))
    out = tasks.drop("state").join(last, F.col("task_id") == F.col("of_task_"), "left").drop("of_task_").withColumn("state", F.coalesce("state", F.lit("OPEN")))
    out = out.where(F.col("state").isin(*OPEN_STATES)) if open_only else out
    return out.orderBy("priority", "created_at", "task_id")


def task_states(events: DataFrame) -> DataFrame:
    """The latest state of each task from an append-only log (task_id, state, at, ord)."""
    return events.groupBy("task_id").agg(F.max_by("state", F.struct("at", "ord")).alias("state"), F.max("at").alias("at"), F.count("*").alias("n_events"))
