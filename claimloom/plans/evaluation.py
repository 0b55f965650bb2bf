"""Metrics over labels, and reviewers' feedback, here turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import evaluate, feedback, rules
from claimloom.plans.claims import _DISPOSITION, _FINDINGS, RULES, lending_cases
from claimloom.plans.registry import query, table


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A rule's guess of document quality, which defers on short texts."""
    docs = table(spark, folder, "documents").select("doc_id", F.length("text").alias("n"), F.contains("text", F.lit("!!")).alias("loud"))
    guess = F.when(F.col("n") < 600, "unknown").when(F.col("loud"), "0").otherwise("1")
    return table(spark, folder, "labels").join(docs, "doc_id").select(F.col("quality").cast("string").alias("expected"), guess.alias("predicted"))


_PAIRS = "p AS (SELECT quality::VARCHAR AS expected, CASE WHEN length(text) < 600 THEN 'unknown' WHEN contains(text, '!!') THEN '0' ELSE '1' END AS predicted FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_PAIRS} SELECT expected, count(*) FILTER (predicted = '0') AS \"0\", count(*) FILTER (predicted = '1') AS \"1\", count(*) FILTER (predicted = 'unknown') AS \"unknown\" FROM p GROUP BY 1")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions by expected label."""
    return evaluate.confusion_matrix(predictions(spark, folder), ["0", "1", "unknown"])


@query(f"""WITH {_PAIRS}, s AS (SELECT count(*) AS total, count(*) FILTER (predicted = 'unknown') AS deferred, count(*) FILTER (predicted <> 'unknown') AS decided, count(*) FILTER (predicted = expected) AS correct FROM p)
SELECT *, round(correct::DOUBLE / decided, 4) AS accuracy_on_decided, round(deferred::DOUBLE / total, 4) AS deferral_rate, round((decided - correct)::DOUBLE / total, 4) AS misclassification_rate FROM s""")
def confusion_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy on what was decided, apart from deferral."""
    return evaluate.confusion_scores(evaluate.confusion(predictions(spark, folder)))


@query(f"WITH {_PAIRS} SELECT expected, predicted, count(*) AS n FROM p WHERE expected <> predicted AND predicted <> 'unknown' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10")
def top_confusions(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most frequent wrong answers."""
    return evaluate.top_confusions(evaluate.confusion(predictions(spark, folder)))


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as truth, documents as extracted: some are absent, some near, some wrong."""
    keys = table(spark, folder, "labels").select("doc_id", "quality", (F.col("toxic") == 1).alias("absent"))
    docs = table(spark, folder, "documents").where("n_chars >= 500").select("doc_id", F.when(F.col("n_chars") % 5 == 0, "WRONG").when(F.col("n_chars") % 5 == 1, "NEAR").otherwise("CORRECT").alias("outcome"))
    langs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("field"))
    return evaluate.extraction_outcomes(keys, docs, ["doc_id"]).join(langs, "doc_id")


_OUTCOMES = """oc AS (SELECT lang AS field, CASE WHEN toxic = 1 THEN CASE WHEN n_chars >= 500 THEN 'SPURIOUS' ELSE 'CORRECT' END WHEN n_chars < 500 THEN 'MISSING' WHEN n_chars % 5 = 0 THEN 'WRONG' WHEN n_chars % 5 = 1 THEN 'NEAR' ELSE 'CORRECT' END AS outcome FROM labels JOIN documents USING (doc_id)),
ct AS (SELECT field, count(*) FILTER (outcome = 'CORRECT') AS correct, count(*) FILTER (outcome = 'NEAR') AS near, count(*) FILTER (outcome = 'WRONG') AS wrong, 0::BIGINT AS not_evaluated, count(*) FILTER (outcome = 'MISSING') AS missing, count(*) FILTER (outcome = 'SPURIOUS') AS spurious FROM oc GROUP BY ROLLUP (field)),
rt AS (SELECT *, correct + near + wrong + spurious + missing AS evaluated, correct + near + wrong + spurious AS attempted FROM ct),
s AS (SELECT *, round(correct::DOUBLE / nullif(attempted, 0), 4) AS "precision", round(correct::DOUBLE / nullif(correct + near + wrong + missing, 0), 4) AS recall, round((wrong + spurious)::DOUBLE / nullif(evaluated, 0), 4) AS dangerous_error_rate, round((missing + near)::DOUBLE / nullif(evaluated, 0), 4) AS safe_failure_rate FROM rt)"""


@query(f"WITH {_OUTCOMES} SELECT *, round(2 * \"precision\" * recall / nullif(\"precision\" + recall, 0), 4) AS f1 FROM s")
def extraction_scores_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of each field and overall: one rollup."""
    return evaluate.extraction_scores(outcomes(spark, folder))


@query(f"WITH {_OUTCOMES} SELECT field, outcome, count(*) AS n FROM oc WHERE outcome IN ('WRONG', 'SPURIOUS') GROUP BY 1, 2")
def dangerous_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that were wrong or invented."""
    return evaluate.dangerous(outcomes(spark, folder)).groupBy("field", "outcome").agg(F.count("*").alias("n"))


def expected_findings(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("case_id"))
    rule = lambda name, outcome, clear: orders.select("case_id", F.lit(name).alias("rule_id"), F.lit(outcome).alias("determination"), F.lit(clear).alias("expect_clear"))
    return rule("R2_STATUS", "MISMATCH", False).unionByName(rule("R1_DOCUMENTS", "MATCH", True)).unionByName(rule("R9_NONE", "MATCH", False))


_SCORES = f"""{_FINDINGS}, x2 AS (SELECT 'R2_STATUS' AS rule_id, CASE WHEN determination = 'MISMATCH' THEN 'CORRECT' ELSE 'WRONG' END AS outcome FROM e WHERE rule_id = 'R2_STATUS'
 UNION ALL SELECT 'R1_DOCUMENTS', CASE WHEN determination IN ('MISMATCH', 'MISSING') THEN 'SPURIOUS' ELSE 'CORRECT' END FROM e WHERE rule_id = 'R1_DOCUMENTS' UNION ALL SELECT 'R9_NONE', 'MISSING' FROM orders)"""


@query(f"{_SCORES} SELECT rule_id, outcome, count(*) AS n FROM x2 GROUP BY 1, 2")
def finding_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Findings against expectations: wrong, missing, or there where none may be."""
    found = evaluate.finding_outcomes(expected_findings(spark, folder), rules.evaluate(lending_cases(spark, folder), RULES))
    return found.groupBy("rule_id", "outcome").agg(F.count("*").alias("n"))


@query(f"""{_SCORES}, {_PAIRS}, {_OUTCOMES}, v AS (
 SELECT 'extraction dangerous errors' AS name, 'extraction.overall.dangerous_error_rate' AS metric, 'max' AS direction, 0.05 AS threshold, (SELECT dangerous_error_rate FROM s WHERE field IS NULL) AS value
 UNION ALL SELECT 'extraction recall', 'extraction.overall.recall', 'min', 0.70, (SELECT recall FROM s WHERE field IS NULL)
 UNION ALL SELECT 'classification misclassification', 'classification.misclassification_rate', 'max', 0.05, (SELECT round((count(*) FILTER (predicted <> 'unknown') - count(*) FILTER (predicted = expected))::DOUBLE / count(*), 4) FROM p)
 UNION ALL SELECT 'finding false positives', 'findings.spurious', 'max', 0.0, NULL)
SELECT name, metric, value, coalesce(CASE WHEN direction = 'max' THEN value <= threshold ELSE value >= threshold END, true) AS passed, CASE WHEN value IS NULL THEN 'not measured' WHEN (direction = 'max' AND value <= threshold) OR (direction = 'min' AND value >= threshold) THEN 'holds' ELSE 'fails' END AS reason FROM v""")
def regression_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics against thresholds; what was not measured is not a failure."""
    overall = evaluate.extraction_scores(outcomes(spark, folder)).where("field is null").drop("field")
    metrics = evaluate.all_metrics(evaluate.unpivoted(overall, "extraction.overall."), evaluate.unpivoted(evaluate.confusion_scores(evaluate.confusion(predictions(spark, folder))), "classification."))
    return evaluate.check_gates(metrics, evaluate.gate_table(spark)).select("name", "metric", "value", "passed", "reason")


@query("""WITH c AS (SELECT item_id, levenshtein(text, regexp_replace(text, 'e', '', 'g'))::DOUBLE / length(text) AS cer FROM benchmark) SELECT count(*) AS n, round(quantile_cont(cer, 0.9) * 1000)::BIGINT AS p90_milli FROM (SELECT round(cer, 4) AS cer FROM c)""")
def ocr_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Error rates of texts with a letter lost: count and 90th percentile."""
    from claimloom.functions import text

    rates = table(spark, folder, "benchmark").select(text.cer(F.col("text"), F.regexp_replace("text", "e", "")).alias("cer"), F.lit(None).cast("double").alias("wer"))
    return evaluate.ocr_scores(rates).select("n", F.round(F.col("p90_cer") * 1000).cast("long").alias("p90_milli"))


def review_log(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as reviewers' decisions."""
    turns = table(spark, folder, "conversations")
    sure = F.when(F.length("text") > 300, "HIGH").when(F.length("text") > 150, "MEDIUM").otherwise("LOW")
    return turns.select(F.col("conv_id").alias("document_id"), F.col("role").alias("field"), F.when(F.length("text") % 3 == 0, "correct").otherwise("accept").alias("action"), sure.alias("original_confidence"), F.col("turn").alias("at"))


@query("""WITH f AS (SELECT conv_id, role, arg_max(CASE WHEN length(text) % 3 = 0 THEN 'correct' ELSE 'accept' END, turn) AS action, arg_max(CASE WHEN length(text) > 300 THEN 'HIGH' WHEN length(text) > 150 THEN 'MEDIUM' ELSE 'LOW' END, turn) AS c FROM conversations GROUP BY 1, 2)
SELECT c AS original_confidence, count(*) AS reviewed, count(*) FILTER (action = 'correct') AS corrected, round(count(*) FILTER (action = 'correct')::DOUBLE / count(*), 4) AS correction_rate FROM f GROUP BY 1""")
def calibration(spark: SparkSession, folder: str) -> DataFrame:
    """How often fields of each confidence were corrected, by the last decision on each."""
    return feedback.calibration(feedback.latest_feedback(review_log(spark, folder)))


@query("""WITH l AS (SELECT user_id AS case_id, event_id % 40 AS document_id, arg_max(CASE event_type WHEN 'view' THEN 'deed' WHEN 'purchase' THEN 'tax' ELSE 'other' END, ts) AS box, arg_max(event_id % 11 = 0, ts) AS gone, max(ts) AS last_at FROM events GROUP BY 1, 2),
k AS (SELECT * FROM l WHERE NOT gone), s AS (SELECT case_id, box, arg_max(document_id, (last_at, document_id)) AS document_id FROM k WHERE box <> 'other' GROUP BY 1, 2)
SELECT * FROM s UNION ALL SELECT case_id, box, document_id FROM k WHERE box = 'other'""")
def board_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """What each box of a case's board holds after all uploads, moves and removals."""
    kind = F.col("event_type")
    events = table(spark, folder, "events").select(F.col("user_id").alias("case_id"), (F.col("event_id") % 40).alias("document_id"), F.when(kind == "view", "deed").when(kind == "purchase", "tax").otherwise("other").alias("box"), F.when(F.col("event_id") % 11 == 0, "remove").otherwise("put").alias("action"), F.col("ts").alias("at"))
    return feedback.boxes(events).select("case_id", "box", "document_id")


@query(f"""{_FINDINGS}, f AS (SELECT *, {_DISPOSITION} AS disposition FROM e), n AS (SELECT l_orderkey AS k, count(*) AS claims FROM lineitem GROUP BY 1)
SELECT case_id, coalesce(claims, 0) AS claims, count(*) AS findings, count(*) FILTER (disposition = 'BLOCKER') AS blockers FROM f LEFT JOIN n ON k = case_id GROUP BY 1, 2""")
def trace_view(spark: SparkSession, folder: str) -> DataFrame:
    """From claims to findings, by case."""
    from claimloom.operators.claims import resolve

    tables = lending_cases(spark, folder)
    claims = tables["claims"].withColumn("document_id", F.col("claim_id"))
    return feedback.trace_view(claims, resolve(tables["claims"]), rules.evaluate(tables, RULES)).select("case_id", "claims", "findings", "blockers")
