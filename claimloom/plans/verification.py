"""Planning and comparing external checks, with customers and orders as cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import rules, verify
from claimloom.plans.registry import query, table

_KEYS = ("property.parcel_identifier", "party.owner", "tax.assessment_number", "project.rera_registration_number")


def customer_resolutions(spark: SparkSession, folder: str) -> DataFrame:
    """What is known of each customer: determinations follow from the keys, values from the name."""
    customer = table(spark, folder, "customer")
    parts = []
    for i, attribute in enumerate(_KEYS):
        outcome = F.element_at(F.array(*map(F.lit, ("MATCH", "MISMATCH", "MISSING", "NOT_DETERMINABLE"))), ((F.col("c_custkey") + i * F.col("c_nationkey")) % 4 + 1).cast("int"))
        parts.append(F.struct(F.lit(attribute).alias("attribute"), outcome.alias("determination"), F.when(outcome != "MISSING", F.concat("c_name", F.lit(f"/{i}"))).alias("value")))
    rows = customer.select(F.col("c_custkey").alias("case_id"), F.explode(F.array(*parts)).alias("r"))
    return rows.select("case_id", F.col("case_id").alias("subject_id"), "r.*")


def customer_plan(spark: SparkSession, folder: str) -> DataFrame:
    cases = table(spark, folder, "customer").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_nationkey") % 5 == 0, "GJ").otherwise("MH").alias("state"))
    return verify.plan(cases, customer_resolutions(spark, folder), verify.source_table(spark))


_D = "['MATCH', 'MISMATCH', 'MISSING', 'NOT_DETERMINABLE'][((c_custkey + {i} * c_nationkey) % 4)::INT + 1]"
_PLAN = f"""c AS (SELECT c_custkey AS case_id, c_name, {', '.join(f"{_D.format(i=i)} AS d{i}" for i in range(4))} FROM customer WHERE c_nationkey % 5 <> 0),
u AS (SELECT *, {', '.join(f"d{i} IN ('MATCH', 'NOT_DETERMINABLE') AS u{i}" for i in range(4))} FROM c),
p AS (
 SELECT case_id, 'SRC_CERSAI' AS source_id, CASE WHEN u0 THEN 'property_identifiers' WHEN u1 THEN 'borrower_identifiers' END AS lookup_key, CASE WHEN u0 THEN c_name || '/0' WHEN u1 THEN c_name || '/1' END AS lookup_value,
  CASE WHEN d0 = 'MISMATCH' AND NOT u1 AND d1 = 'MISMATCH' THEN 'property_identifiers,borrower_identifiers' WHEN d0 = 'MISMATCH' THEN 'property_identifiers' WHEN NOT u0 AND d1 = 'MISMATCH' THEN 'borrower_identifiers' ELSE '' END AS ambiguous, false AS gate, 'AUTOMATED' AS how FROM u
 UNION ALL SELECT case_id, 'SRC_IGR_ESEARCH', CASE WHEN u0 THEN 'cts_number' END, CASE WHEN u0 THEN c_name || '/0' END, CASE WHEN d0 = 'MISMATCH' THEN 'cts_number' ELSE '' END, false, 'MANUAL' FROM u
 UNION ALL SELECT case_id, 'SRC_MAHARERA', CASE WHEN u3 THEN 'maharera_registration_number' END, CASE WHEN u3 THEN c_name || '/3' END, CASE WHEN d3 = 'MISMATCH' THEN 'maharera_registration_number' ELSE '' END, d3 = 'MISSING', 'MANUAL' FROM u
 UNION ALL SELECT case_id, 'SRC_MCGM_PTAX', CASE WHEN u2 THEN 'property_account_number_pid' END, CASE WHEN u2 THEN c_name || '/2' END, CASE WHEN d2 = 'MISMATCH' THEN 'property_account_number_pid,assessment_number' ELSE '' END, false, 'MANUAL' FROM u
 UNION ALL SELECT case_id, 'SRC_PROPERTY_CARD_MH', CASE WHEN u0 THEN 'cts_number' END, CASE WHEN u0 THEN c_name || '/0' END, CASE WHEN d0 = 'MISMATCH' THEN 'cts_number' ELSE '' END, d0 = 'MISSING', 'MANUAL' FROM u),
x AS (SELECT case_id, source_id, CASE WHEN gate OR lookup_key IS NULL THEN 'SKIP' ELSE how END AS execution, lookup_key, lookup_value, ambiguous FROM p)"""


@query(f"WITH {_PLAN} SELECT * FROM x")
def verify_plan_min_key(spark: SparkSession, folder: str) -> DataFrame:
    """For each case and source: how it is asked, with the single narrowest undisputed key."""
    planned = customer_plan(spark, folder)
    return planned.select("case_id", "source_id", "execution", "lookup_key", "lookup_value", F.array_join("ambiguous", ",").alias("ambiguous"))


@query(f"WITH {_PLAN} SELECT case_id, count(*) FILTER (execution = 'AUTOMATED') AS automated, count(*) FILTER (execution = 'MANUAL') AS manual, count(*) FILTER (execution = 'SKIP') AS skipped, count(*) FILTER (execution <> 'SKIP') AS actionable FROM x GROUP BY 1")
def verify_plan_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Plans counted by case."""
    return verify.plan_summary(customer_plan(spark, folder))


@query("SELECT source_id, priority FROM (VALUES ('SRC_IGR_ESEARCH', 2), ('SRC_PROPERTY_CARD_MH', 5)) t(source_id, priority)")
def sources_for_owner(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that can verify an owner."""
    return verify.sources_for(verify.source_table(spark), "party.owner").select("source_id", "priority")


def order_results(spark: SparkSession, folder: str) -> DataFrame:
    """Orders' totals against what their lines add up to, as an outside source would report it.

    The internal reading is disputed where lines differ in status; records are as old as the last shipment.
    """
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("paise"), F.count_distinct("l_linestatus").alias("states"), F.count("*").alias("n"), F.max("l_shipdate").cast("timestamp").alias("last"), F.max("l_linenumber").alias("lines")
    )
    orders = table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    value = lambda key: F.struct(F.lit("money").alias("kind"), key.cast("string").alias("cmp_key"), key.cast("string").alias("raw"), F.lit(None).cast("decimal(28,6)").alias("sq_m"), F.lit("unspecified").alias("basis"))
    thousands = lambda paise: F.floor(paise / 1_000_000).cast("long")
    compared = verify.compare_values(F.lit("transaction.consideration"), value(thousands(F.round(F.col("o_totalprice") * 100).cast("long"))), value(thousands(F.col("paise"))))
    internal = F.when(F.col("o_orderkey") % 7 == 0, "MISSING").when(F.col("states") > 1, "MISMATCH").otherwise("MATCH")
    stale = verify.is_stale(F.col("o_orderdate").cast("timestamp") + F.expr("interval 400 days"), F.col("last"), F.lit(320))
    external = F.when(F.col("lines") > 1, value(thousands(F.col("paise"))))
    status = verify.observed_status(compared, F.col("n").isNotNull(), external, internal, stale)
    tier = F.element_at(F.array(*map(F.lit, ("T1", "T2", "T4", "T6"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    out = orders.select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("SRC_"), F.col("o_custkey") % 3).alias("source_id"), F.lit("transaction.consideration").alias("attribute"), tier.alias("tier"), status.alias("status"), external["raw"].alias("external_value"))
    return out.withColumn("confidence", verify.observed_confidence(F.col("status"), F.col("tier")))


_RESULTS = """l AS (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS paise, count(DISTINCT l_linestatus) AS states, count(*) AS n, max(l_shipdate) AS last, max(l_linenumber) AS lines FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey AS case_id, 'SRC_' || (o_custkey % 3) AS source_id, ['T1', 'T2', 'T4', 'T6'][(o_custkey % 4)::INT + 1] AS tier, n, lines, states, round(o_totalprice * 100)::BIGINT // 1000000 AS own, paise // 1000000 AS other,
 epoch(o_orderdate::TIMESTAMP) + 400 * 86400 - epoch(last::TIMESTAMP) > 320 * 86400 AS stale FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
k AS (SELECT *, CASE WHEN case_id % 7 = 0 THEN 'MISSING' WHEN states > 1 THEN 'MISMATCH' ELSE 'MATCH' END AS internal, CASE WHEN own = other THEN 'MATCH' ELSE 'MISMATCH' END AS cmp FROM j),
r AS (SELECT case_id, source_id, tier, CASE WHEN lines > 1 THEN other::VARCHAR END AS external_value, CASE WHEN n IS NULL THEN 'NOT_FOUND_IN_SOURCE' WHEN lines <= 1 THEN 'NOT_APPLICABLE' WHEN internal = 'MISSING' THEN 'NOT_APPLICABLE' WHEN stale THEN 'STALE'
 WHEN internal = 'MISMATCH' AND cmp = 'MATCH' THEN 'PARTIAL_MATCH' ELSE cmp END AS status FROM k),
z AS (SELECT *, status IN ('MATCH', 'PARTIAL_MATCH', 'MISMATCH', 'NOT_FOUND_IN_SOURCE', 'STALE') OR (status = 'NOT_APPLICABLE' AND coalesce(external_value, '') <> '') AS counts FROM r)"""


@query(f"""WITH {_RESULTS} SELECT case_id, source_id, tier, status, external_value, CASE WHEN status = 'NOT_APPLICABLE' THEN 'INSUFFICIENT' WHEN status = 'STALE' THEN 'LOW'
 WHEN tier = 'T6' THEN 'INSUFFICIENT' WHEN status = 'MATCH' AND tier IN ('T1', 'T2') THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM r""")
def verify_compare(spark: SparkSession, folder: str) -> DataFrame:
    """What an observation says, and how far its source's tier lets it be trusted."""
    return order_results(spark, folder).drop("attribute")


@query(f"""WITH {_RESULTS} SELECT source_id, count(*) AS total, count(*) FILTER (counts) AS answered, count(*) FILTER (status IN ('MISMATCH', 'NOT_FOUND_IN_SOURCE')) AS adverse,
 count(*) FILTER (status IN ('PARTIAL_MATCH', 'STALE', 'MISMATCH', 'NOT_FOUND_IN_SOURCE')) AS needs_review FROM z GROUP BY 1""")
def verify_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Results counted by source."""
    return verify.results_summary(order_results(spark, folder), "source_id")


def _tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Customers as cases with the results of all their orders."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer"))
    results = order_results(spark, folder).join(orders, F.col("case_id") == F.col("order")).withColumn("case_id", F.col("customer")).drop("order", "customer")
    return {"cases": table(spark, folder, "customer").select(F.col("c_custkey").alias("case_id")), "verification": results}


_BY_CUSTOMER = f"{_RESULTS}, b AS (SELECT o_custkey AS k, z.* FROM z JOIN orders ON o_orderkey = case_id)"


@query(f"""WITH {_BY_CUSTOMER}, g AS (SELECT k, count(*) FILTER (counts) AS answered, count(*) FILTER (counts AND tier <> 'T6') AS able, arg_min(status, CASE status WHEN 'MISMATCH' THEN 0 WHEN 'NOT_FOUND_IN_SOURCE' THEN 1 WHEN 'PARTIAL_MATCH' THEN 2 WHEN 'STALE' THEN 3 WHEN 'MATCH' THEN 4 ELSE 5 END) FILTER (counts) AS worst FROM b GROUP BY 1)
SELECT c_custkey AS case_id, CASE WHEN k IS NULL OR answered = 0 OR able = 0 THEN 'NOT_DETERMINABLE' WHEN worst = 'NOT_FOUND_IN_SOURCE' THEN 'MISSING' WHEN worst IN ('MATCH', 'MISMATCH', 'PARTIAL_MATCH') THEN worst ELSE 'NOT_DETERMINABLE' END AS determination, worst AS detail FROM customer LEFT JOIN g ON k = c_custkey""")
def external_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """The worst usable answer of all sources."""
    return rules.builder("external_agreement")(_tables(spark, folder), {"attribute": "transaction.consideration"}).drop("vars")


@query(f"""WITH {_BY_CUSTOMER}, g AS (SELECT k, count(*) FILTER (coalesce(external_value, '') <> '') AS records, count(*) FILTER (status = 'NOT_FOUND_IN_SOURCE') AS absent FROM b WHERE source_id = 'SRC_1' GROUP BY 1)
SELECT c_custkey AS case_id, CASE WHEN k IS NULL OR (records = 0 AND absent = 0) THEN 'NOT_DETERMINABLE' WHEN records > 0 THEN 'MISMATCH' ELSE 'MATCH' END AS determination FROM customer LEFT JOIN g ON k = c_custkey""")
def record_presence(spark: SparkSession, folder: str) -> DataFrame:
    """Whether one register holds a record, where a record is bad news."""
    return rules.builder("external_record_presence")(_tables(spark, folder), {"attribute": "transaction.consideration", "source_id": "SRC_1", "presence_means": "adverse"}).select("case_id", "determination")


@query(f"""WITH {_BY_CUSTOMER}, g AS (SELECT k, count(*) FILTER (counts) AS answered, count(*) FILTER (status <> 'NOT_APPLICABLE') AS in_scope FROM b GROUP BY 1)
SELECT c_custkey AS case_id, CASE WHEN k IS NULL THEN 'NOT_DETERMINABLE' WHEN in_scope = 0 THEN 'NOT_APPLICABLE' WHEN answered = 0 THEN 'NOT_DETERMINABLE' WHEN answered = in_scope THEN 'MATCH' ELSE 'PARTIAL_MATCH' END AS determination,
 coalesce(answered, 0) || ' of ' || coalesce(in_scope, 0) AS detail FROM customer LEFT JOIN g ON k = c_custkey""")
def verification_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many in-scope checks were answered."""
    return rules.builder("verification_coverage")(_tables(spark, folder), {}).drop("vars")


@query("""SELECT user_id AS task_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_events FROM events GROUP BY 1""")
def task_queue_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The latest state of each task in an append-only log."""
    log = table(spark, folder, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("ord"))
    return verify.task_states(log).select("task_id", "state", "n_events")
