"""Resolution and rules, with orders as cases and their lines as claims and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions.areas import sq_m
from claimloom.model import DETERMINACIES, DETERMINATIONS, EQUITABLE, SEVERITIES
from claimloom.operators import rules
from claimloom.operators.claims import active, ownership_only, resolve
from claimloom.plans.registry import query, table

STRENGTHS = "CASE l_returnflag WHEN 'A' THEN 'title_transferring' WHEN 'N' THEN 'contractual' ELSE 'administrative' END"


def status_claims(lineitem: DataFrame) -> DataFrame:
    """Each line claims its order's status; equal claims weigh the same, so the letter gives the order."""
    return lineitem.select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_orderkey").alias("subject_id"),
        F.lit("status").alias("attribute"),
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("claim_id"),
        F.ascii("l_linestatus").cast("long").alias("ord"),
        F.lit("text").alias("kind"),
        F.col("l_linestatus").alias("cmp_key"),
        F.lit(None).cast("decimal(28,6)").alias("sq_m"),
        F.lit("unspecified").alias("basis"),
        F.expr(STRENGTHS).alias("strength"),
        F.when(F.col("l_returnflag") == "R", F.concat_ws(":", "l_orderkey", F.col("l_linenumber") - 1)).alias("supersedes"),
    )


def _asked(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderkey").alias("subject_id"), F.lit("status").alias("attribute"))


def _resolved_sql(lines: str) -> str:
    return f"""
WITH c AS (SELECT l_orderkey AS k, l_linestatus AS v, count(*) AS n FROM {lines} GROUP BY 1, 2),
s AS (SELECT k, sum(n)::BIGINT AS n_claims, count(*) AS n_clusters, max(n) AS largest, first(v ORDER BY n DESC, v) AS val FROM c GROUP BY 1)
SELECT o_orderkey AS case_id, CASE WHEN n_claims IS NULL THEN 'MISSING' WHEN n_claims = 1 THEN 'NOT_DETERMINABLE' WHEN n_clusters = 1 THEN 'MATCH' ELSE 'MISMATCH' END AS determination,
 val AS value, coalesce(n_claims, 0) AS n_claims, coalesce(n_clusters, 0) AS n_clusters, coalesce(largest, 0) AS largest, coalesce(n_claims - largest, 0) AS dissent,
 CASE WHEN n_claims IS NULL THEN 'INSUFFICIENT' WHEN n_claims = 1 THEN 'LOW' WHEN n_clusters = 1 THEN 'HIGH' ELSE 'INSUFFICIENT' END AS confidence
FROM orders LEFT JOIN s ON k = o_orderkey"""


RESOLVED = ["case_id", "determination", "value", "n_claims", "n_clusters", "largest", "dissent", "confidence"]


@query(_resolved_sql("lineitem"))
def resolve_linestatus(spark: SparkSession, folder: str) -> DataFrame:
    """What an order's lines establish about its status; conflicts stay visible."""
    return resolve(status_claims(table(spark, folder, "lineitem")), _asked(table(spark, folder, "orders"))).select(*RESOLVED)


@query(_resolved_sql("(SELECT * FROM lineitem WHERE l_returnflag IN ('A', 'R'))"))
def resolve_ownership_only(spark: SparkSession, folder: str) -> DataFrame:
    """The same from instruments that can establish ownership alone."""
    return resolve(ownership_only(status_claims(table(spark, folder, "lineitem"))), _asked(table(spark, folder, "orders"))).select(*RESOLVED)


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_orderkey || ':' || l_linenumber AS id, CASE WHEN l_returnflag = 'R' THEN l_orderkey || ':' || (l_linenumber - 1) END AS gone FROM lineitem)
SELECT l_orderkey AS case_id, count(*) AS n_active, count(DISTINCT id) AS n_ids FROM l WHERE id NOT IN (SELECT gone FROM l WHERE gone IS NOT NULL) GROUP BY 1""")
def active_claims_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    """Claims that none of the same set supersedes."""
    kept = active(status_claims(table(spark, folder, "lineitem")))
    return kept.groupBy("case_id").agg(F.count("*").alias("n_active"), F.count_distinct("claim_id").alias("n_ids"))


_LINE_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"""
WITH RECURSIVE a AS (
 SELECT l_partkey AS k, row_number() OVER (PARTITION BY l_partkey ORDER BY {_LINE_ORDER}) AS rn,
  round(l_quantity::DECIMAL(12,0) * CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0.09290304 ELSE 0.83612736 END::DECIMAL(12,8), 6)::DECIMAL(28,6) AS sq FROM lineitem),
r AS (
 SELECT k, rn, [sq] AS leaders, [1::BIGINT] AS ns FROM a WHERE rn = 1
 UNION ALL
 SELECT k, rn, CASE WHEN i IS NULL OR i = 0 THEN list_append(leaders, sq) ELSE leaders END,
  CASE WHEN i IS NULL OR i = 0 THEN list_append(ns, 1::BIGINT) ELSE list_concat(list_concat(ns[1:i-1], [ns[i] + 1]), ns[i+1:]) END
 FROM (SELECT a.k, a.rn, a.sq, r.leaders, r.ns, list_position([x = a.sq OR abs(x - a.sq) * 100 <= 2 * greatest(x, a.sq) FOR x IN r.leaders], true) AS i FROM r JOIN a ON a.k = r.k AND a.rn = r.rn + 1))
SELECT k AS case_id, CASE WHEN max(rn) = 1 THEN 'NOT_DETERMINABLE' WHEN max(len(leaders)) = 1 THEN 'MATCH' ELSE 'MISMATCH' END AS determination,
 max(rn) AS n_claims, max(len(leaders)) AS n_clusters, max(list_max(ns)) AS largest, (arg_max(leaders[list_position(ns, list_max(ns))], rn) * 1000000)::BIGINT AS value_micro
FROM r GROUP BY k""")
def resolve_area_tolerance(spark: SparkSession, folder: str) -> DataFrame:
    """Areas that agree within tolerance of a group's first member, in a fixed order."""
    order = Window.partitionBy("l_partkey").orderBy(*_LINE_ORDER.split(", "))
    unit = F.when(F.col("l_returnflag") == "A", "SQ_M").when(F.col("l_returnflag") == "N", "SQ_FT").otherwise("SQ_YARD")
    area = sq_m(F.col("l_quantity"), unit)
    held = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("case_id"), F.col("l_partkey").alias("subject_id"), F.lit("area").alias("attribute"), F.row_number().over(order).cast("long").alias("ord"), F.lit("area").alias("kind"), area.cast("string").alias("cmp_key"), area.alias("sq_m"), F.lit("unspecified").alias("basis")
    )
    value = (F.col("value").cast("decimal(28,6)") * 1000000).cast("long").alias("value_micro")
    return resolve(held).select("case_id", "determination", "n_claims", "n_clusters", "largest", value)


_DISPOSITION = """CASE WHEN determination = 'NOT_APPLICABLE' THEN 'NOT_APPLICABLE'
 WHEN determination = 'NOT_DETERMINABLE' THEN CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'REVIEW_REQUIRED' ELSE 'INFORMATIONAL' END
 WHEN determination IN ('MATCH', 'PARTIAL_MATCH') THEN 'CLEARED'
 WHEN determinacy IN ('DETERMINISTIC', 'EXTERNAL_VERIFIED') AND severity IN ('CRITICAL', 'HIGH') THEN 'BLOCKER'
 WHEN severity = 'INFORMATIONAL' THEN 'INFORMATIONAL' ELSE 'REVIEW_REQUIRED' END"""


@query(f"""
SELECT *, {_DISPOSITION} AS disposition,
 CASE WHEN determination = 'NOT_DETERMINABLE' THEN 'INSUFFICIENT' WHEN determinacy IN ('DETERMINISTIC', 'EXTERNAL_VERIFIED') THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
FROM (SELECT unnest({list(DETERMINATIONS)}) AS determination), (SELECT unnest({list(SEVERITIES)}) AS severity), (SELECT unnest({list(DETERMINACIES)}) AS determinacy)""")
def disposition_grid(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of every combination of determination, severity and determinacy."""
    each = lambda values, name: F.explode(F.array(*map(F.lit, values))).alias(name)
    grid = spark.range(1).select(each(DETERMINATIONS, "determination")).select("determination", each(SEVERITIES, "severity")).select("determination", "severity", each(DETERMINACIES, "determinacy"))
    columns = [F.col(c) for c in ("determination", "severity", "determinacy")]
    return grid.withColumns({"disposition": rules.disposition(*columns), "confidence": rules.finding_confidence(columns[0], columns[2])})


# -- orders as lending cases ----------------------------------------------------------------

RULES = [
    {"rule_id": "R1_DOCUMENTS", "title": "", "category": "completeness", "severity": "MEDIUM", "determinacy": "DETERMINISTIC", "check": "documents_present", "params": {"document_types": ["A", "N", "R"]}, "message": "missing {detail}"},
    {"rule_id": "R2_STATUS", "title": "", "category": "cross_document", "severity": "HIGH", "determinacy": "DETERMINISTIC", "check": "claim_consistency", "params": {"attribute": "status"}, "message": "{detail}"},
    {"rule_id": "R3_OWNER", "title": "", "category": "title", "severity": "CRITICAL", "determinacy": "MODEL_PROPOSED", "check": "ownership_established", "params": {"attribute": "status"}, "citations": ["REQ_A"], "message": "{detail}"},
    {"rule_id": "R4_MORTGAGE", "title": "", "category": "security", "severity": "HIGH", "determinacy": "DETERMINISTIC", "check": "mortgage_registration_required", "citations": ["REQ_B"], "message": "{detail}"},
    {"rule_id": "R5_ORIGINALS", "title": "", "category": "security", "severity": "INFORMATIONAL", "determinacy": "DETERMINISTIC", "check": "originals_held", "params": {"document_types": ["A", "N"]}, "applicability": {"security_types": [EQUITABLE]}, "message": "{detail}"},
    {"rule_id": "R6_LTV", "title": "", "category": "ltv", "severity": "CRITICAL", "determinacy": "DETERMINISTIC", "check": "ltv_within_cap", "params": {"slabs": [[100_000, 120], [200_000, 101], [None, 99]]}, "applicability": {"lender_types": ["HFC"]}, "citations": ["REQ_C"], "message": "{detail}"},
]


def lending_cases(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """orders as cases: their lines' flags are document types, line states are custody."""
    lineitem = table(spark, folder, "lineitem")
    held = lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("present"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("property_value_paise"))
    security = F.element_at(F.array(F.lit("unknown"), F.lit(EQUITABLE), F.lit("english")), (F.col("o_custkey") % 3 + 1).cast("int"))
    cases = table(spark, folder, "orders").join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("case_id"),
        F.when(F.col("o_orderpriority") < "3", "HFC").otherwise("NBFC").alias("lender_type"),
        F.when(F.col("o_orderstatus") == "O", "housing_loan").otherwise("loan_against_property").alias("product"),
        F.lit("MH").alias("state"),
        F.element_at(F.array(*map(F.lit, ("unknown", "initial_purchase", "resale_purchase", "loan_against_owned_property"))), (F.col("o_custkey") % 4 + 1).cast("int")).alias("transaction_type"),
        security.alias("security_type"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("sanctioned_paise"),
        F.lit(None).cast("long").alias("outstanding_paise"),
        "property_value_paise",
        F.coalesce("present", F.array().cast("array<string>")).alias("present"),
        F.lit(None).cast("array<string>").alias("expected_documents"),
        F.col("o_orderdate").cast("date").alias("regulatory_as_of"),
    )
    documents = lineitem.select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("document_type"), F.struct("l_shipdate", "l_linenumber", "l_linestatus").alias("ord"), F.when(F.col("l_linestatus") == "F", "original_held").otherwise("photocopy").alias("custody"))
    return {"cases": cases, "documents": documents, "claims": status_claims(lineitem)}


_CASES = f"""
c AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderpriority < '3' THEN 'HFC' ELSE 'NBFC' END AS lender, ['unknown', '{EQUITABLE}', 'english'][(o_custkey % 3)::INT + 1] AS security,
 ['unknown', 'initial_purchase', 'resale_purchase', 'loan_against_owned_property'][(o_custkey % 4)::INT + 1] AS txn, round(o_totalprice * 100)::BIGINT AS loan, o_orderdate FROM orders),
d AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_returnflag)) AS present, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS val, count(*) AS n, count(DISTINCT l_linestatus) AS ns,
 count(*) FILTER (l_returnflag IN ('A', 'R')) AS own_n, count(DISTINCT l_linestatus) FILTER (l_returnflag IN ('A', 'R')) AS own_ns FROM lineitem GROUP BY 1),
t AS (SELECT l_orderkey AS k, l_returnflag AS f, arg_max(l_linestatus, (l_shipdate, l_linenumber, l_linestatus)) AS last FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2),
o AS (SELECT k, count(*) AS types, count(*) FILTER (last <> 'F') AS copies FROM t GROUP BY 1)"""
_FINDINGS = f"""
WITH {_CASES},
x AS (SELECT c.*, d.present, d.val, coalesce(d.n, 0) AS n, d.ns, coalesce(d.own_n, 0) AS own_n, d.own_ns, coalesce(o.types, 0) AS types, coalesce(o.copies, 0) AS copies FROM c LEFT JOIN d ON d.k = case_id LEFT JOIN o ON o.k = case_id),
e AS (
 SELECT case_id, 'R1_DOCUMENTS' AS rule_id, 'MEDIUM' AS severity, 'DETERMINISTIC' AS determinacy, false AS regulatory, CASE WHEN len(present) = 3 THEN 'MATCH' ELSE 'MISSING' END AS determination FROM x
 UNION ALL SELECT case_id, 'R2_STATUS', 'HIGH', 'DETERMINISTIC', false, CASE WHEN n = 0 THEN 'MISSING' WHEN n = 1 THEN 'NOT_DETERMINABLE' WHEN ns = 1 THEN 'MATCH' ELSE 'MISMATCH' END FROM x
 UNION ALL SELECT case_id, 'R3_OWNER', 'CRITICAL', 'MODEL_PROPOSED', true, CASE WHEN own_n = 0 THEN 'MISSING' WHEN own_n = 1 THEN 'NOT_DETERMINABLE' WHEN own_ns = 1 THEN 'MATCH' ELSE 'MISMATCH' END FROM x
 UNION ALL SELECT case_id, 'R4_MORTGAGE', 'HIGH', 'DETERMINISTIC', true, CASE security WHEN 'unknown' THEN 'NOT_DETERMINABLE' WHEN '{EQUITABLE}' THEN 'NOT_APPLICABLE' ELSE 'MISSING' END FROM x
 UNION ALL SELECT case_id, 'R5_ORIGINALS', 'INFORMATIONAL', 'DETERMINISTIC', false, CASE WHEN security <> '{EQUITABLE}' THEN 'NOT_APPLICABLE' WHEN types < 2 THEN 'MISSING' WHEN copies > 0 THEN 'MISMATCH' ELSE 'MATCH' END FROM x
 UNION ALL SELECT case_id, 'R6_LTV', 'CRITICAL', 'DETERMINISTIC', true, CASE WHEN lender <> 'HFC' THEN 'NOT_APPLICABLE' WHEN val IS NULL THEN 'NOT_DETERMINABLE'
  WHEN round_even(loan::DOUBLE * 100 / val, 2) <= CASE WHEN loan <= 10000000 THEN 120 WHEN loan <= 20000000 THEN 101 ELSE 99 END THEN 'MATCH' ELSE 'MISMATCH' END FROM x)"""


@query(f"{_FINDINGS} SELECT case_id, rule_id, severity, determination, {_DISPOSITION} AS disposition, regulatory FROM e")
def rules_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Six rules over all orders: applicability, predicates, dispositions."""
    return rules.evaluate(lending_cases(spark, folder), RULES).select("case_id", "rule_id", "severity", "determination", "disposition", "regulatory")


@query(f"""{_FINDINGS}, f AS (SELECT *, {_DISPOSITION} AS disposition FROM e)
SELECT rule_id, count(*) AS total, count(*) FILTER (disposition = 'BLOCKER') AS blockers, count(*) FILTER (disposition = 'REVIEW_REQUIRED') AS review_required, count(*) FILTER (disposition = 'CLEARED') AS cleared,
 count(*) FILTER (disposition = 'INFORMATIONAL') AS informational, count(*) FILTER (disposition = 'NOT_APPLICABLE') AS not_applicable, count(*) FILTER (determination = 'NOT_DETERMINABLE') AS not_determinable,
 count(*) FILTER (regulatory) AS regulatory, count(*) FILTER (NOT regulatory) AS business, count(*) AS advisory FROM f GROUP BY 1""")
def rules_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of findings by rule, in one pass."""
    return rules.summarise(rules.evaluate(lending_cases(spark, folder), RULES), "rule_id")


@query("SELECT 0::BIGINT AS n_findings")
def rules_enforced_drafts(spark: SparkSession, folder: str) -> DataFrame:
    """Drafts are never enforced: no findings."""
    return rules.evaluate(lending_cases(spark, folder), RULES, enforce=True).agg(F.count("*").alias("n_findings"))


_DATED = [
    {"rule_id": "D1", "applicability": {"effective_from": "1995-01-01"}},
    {"rule_id": "D2", "applicability": {"effective_to": "1996-06-30", "lender_types": ["HFC"]}},
    {"rule_id": "D3", "applicability": {"requires_all_documents": ["A", "R"], "products": ["housing_loan"]}},
    {"rule_id": "D4", "applicability": {"requires_any_document": ["N"], "transaction_types": ["initial_purchase", "resale_purchase"]}},
]


@query(f"""
WITH {_CASES}, x AS (SELECT c.*, orders.o_orderstatus, coalesce(present, []) AS present, c.o_orderdate::DATE AS as_of FROM c JOIN orders ON o_orderkey = case_id LEFT JOIN d ON d.k = case_id),
e AS (
 SELECT 'D1' AS rule_id, CASE WHEN as_of < DATE '1995-01-01' THEN 'not in force yet' END AS why FROM x
 UNION ALL SELECT 'D2', CASE WHEN as_of > DATE '1996-06-30' THEN 'superseded' WHEN lender <> 'HFC' THEN 'lender_type not allowed' END FROM x
 UNION ALL SELECT 'D3', CASE WHEN o_orderstatus <> 'O' THEN 'product not allowed' WHEN NOT list_has_all(present, ['A', 'R']) THEN 'required documents missing' END FROM x
 UNION ALL SELECT 'D4', CASE WHEN txn NOT IN ('initial_purchase', 'resale_purchase') THEN 'transaction_type not allowed' WHEN NOT list_contains(present, 'N') THEN 'none of the alternative documents' END FROM x)
SELECT rule_id, coalesce(why, 'applies') AS reason, count(*) AS n FROM e GROUP BY 1, 2""")
def applicability_effective_dating(spark: SparkSession, folder: str) -> DataFrame:
    """Why dated rules don't apply to orders, the first reason of each."""
    from datetime import date

    dated = [{"title": "", "category": "", "severity": "LOW", "determinacy": "DETERMINISTIC", "check": "documents_present", "message": "", **r, "applicability": {k: date.fromisoformat(v) if k.startswith("effective") else v for k, v in r["applicability"].items()}} for r in _DATED]
    grid = rules.applicability(lending_cases(spark, folder)["cases"], rules.rule_table(spark, dated))
    return grid.groupBy("rule_id", F.coalesce("why_not", F.lit("applies")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
WITH {_CASES} SELECT case_id, CASE WHEN val IS NULL THEN 'NOT_DETERMINABLE' WHEN round_even(loan::DOUBLE * 100 / val, 2) <= cap THEN 'MATCH' ELSE 'MISMATCH' END AS determination, cap
FROM (SELECT c.*, val, CASE WHEN loan <= 10000000 THEN 120 WHEN loan <= 20000000 THEN 101 ELSE 99 END AS cap FROM c LEFT JOIN d ON d.k = case_id)""")
def ltv_slabs(spark: SparkSession, folder: str) -> DataFrame:
    """Loan to value against the cap of the loan's slab; upper bounds belong to their slab."""
    cap = rules.slab_cap(F.col("sanctioned_paise"), RULES[5]["params"]["slabs"])
    cases = lending_cases(spark, folder)["cases"]
    return cases.select("case_id", rules.within_cap(F.col("sanctioned_paise"), F.col("property_value_paise"), cap).alias("determination"), cap.alias("cap"))


@query(f"""
WITH {_CASES} SELECT case_id, CASE WHEN txn = 'unknown' THEN 'NOT_DETERMINABLE' WHEN txn = 'loan_against_owned_property' THEN 'NOT_APPLICABLE' WHEN val IS NULL OR ns > 1 THEN 'NOT_DETERMINABLE' WHEN val <= loan THEN 'MATCH' ELSE 'MISMATCH' END AS determination
FROM c LEFT JOIN d ON d.k = case_id""")
def consideration_cap(spark: SparkSession, folder: str) -> DataFrame:
    """The value that LTV is computed from against the documented consideration, which conflicts make unusable."""
    tables = lending_cases(spark, folder)
    known = resolve(tables["claims"]).select("case_id", "determination")
    met = tables["cases"].join(known, "case_id", "left")
    outcome = rules.documented_cap(F.col("transaction_type"), F.col("property_value_paise"), F.col("determination"), F.col("sanctioned_paise"))
    return met.select("case_id", outcome.alias("determination"))


@query(f"WITH {_CASES} SELECT case_id, CASE WHEN coalesce(types, 0) < 2 THEN 'MISSING' WHEN copies > 0 THEN 'MISMATCH' ELSE 'MATCH' END AS determination FROM c LEFT JOIN o ON o.k = case_id")
def originals_held(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the last document of each type is an original."""
    return rules.builder("originals_held")(lending_cases(spark, folder), {"document_types": ["A", "N"]}).select("case_id", "determination")


@query(f"WITH {_CASES} SELECT case_id, CASE WHEN len(missing) = 0 THEN 'MATCH' ELSE 'MISSING' END AS determination, array_to_string(missing, ', ') AS detail FROM (SELECT case_id, [x FOR x IN ['A', 'N', 'R'] IF NOT list_contains(coalesce(present, []), x)] AS missing FROM c LEFT JOIN d ON d.k = case_id)")
def documents_present(spark: SparkSession, folder: str) -> DataFrame:
    """Which expected document types a case lacks."""
    return rules.builder("documents_present")(lending_cases(spark, folder), {"document_types": ["A", "N", "R"]}).drop("vars")


_REQUIREMENTS = [("REQ_A", "RULE_READY"), ("REQ_B", "REQUIRES_LEGAL_REVIEW")]


@query(f"""{_FINDINGS}, f AS (SELECT *, {_DISPOSITION} AS disposition FROM e),
g AS (SELECT rule_id, count(*) AS n_findings, count(*) FILTER (disposition = 'BLOCKER') AS n_blockers FROM f GROUP BY 1),
r(rule_id, severity, "check", cite) AS (VALUES ('R1_DOCUMENTS', 'MEDIUM', 'documents_present', NULL), ('R2_STATUS', 'HIGH', 'claim_consistency', NULL), ('R3_OWNER', 'CRITICAL', 'ownership_established', 'REQ_A'),
 ('R4_MORTGAGE', 'HIGH', 'mortgage_registration_required', 'REQ_B'), ('R5_ORIGINALS', 'INFORMATIONAL', 'originals_held', NULL), ('R6_LTV', 'CRITICAL', 'ltv_within_cap', 'REQ_C'))
SELECT rule_id, severity, "check", n_findings, n_blockers, cite AS cited, CASE WHEN cite IS NOT NULL THEN (cite NOT IN ('REQ_A', 'REQ_B'))::BIGINT ELSE -1 END AS n_unknown FROM r LEFT JOIN g USING (rule_id)""")
def rules_view(spark: SparkSession, folder: str) -> DataFrame:
    """Each rule with its findings and the requirements it cites."""
    from claimloom.operators.feedback import rules_view as view

    out = view(rules.rule_table(spark, RULES), rules.evaluate(lending_cases(spark, folder), RULES), spark.createDataFrame(_REQUIREMENTS, "id string, status string"))
    return out.withColumns({"cited": F.nullif(F.array_join("cited", ","), F.lit("")), "n_unknown": F.coalesce("n_unknown", F.lit(-1))})
