"""Metrics that keep being wrong apart from declining to answer. Rates have four decimals and are null on empty counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.areas import TOLERANCE_PCT, within_tolerance
from claimloom.functions.binding import let
from claimloom.functions.names import match_names
from claimloom.functions.text import alnum
from claimloom.model import OUTCOMES, rank

# -- fixed values -----------------------------------------------------------------------
DEFERRED = "unknown"
SMALL_CORPUS = 30
NAME_FIELDS = ("seller", "buyer", "owner", "assessee", "mortgagor", "mortgagee", "recipient", "promoter")
#: name, metric, direction, threshold, required
GATES = (
    ("extraction dangerous errors", "extraction.overall.dangerous_error_rate", "max", 0.05, False),
    ("extraction recall", "extraction.overall.recall", "min", 0.70, False),
    ("classification misclassification", "classification.misclassification_rate", "max", 0.05, False),
    ("finding false positives", "findings.spurious", "max", 0.0, False),
)


def rate(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole), 4)


def compare_to_truth(field: Column, kind: Column, expected: Column, actual: Column) -> Column:
    """CORRECT, NEAR, WRONG or NOT_EVALUATED. expected: struct of text, paise, date_value, sq_m, basis; actual: struct of raw,
    cmp_key, paise, date_value, sq_m, basis.
    """
    same = lambda want, got: F.when(want.isNull(), "NOT_EVALUATED").when(want == got, "CORRECT").otherwise("WRONG")
    squeezed = lambda c: F.regexp_replace(F.upper(c), r"\s+", "")
    area = (
        F.when(expected["sq_m"].isNull(), "NOT_EVALUATED")
        .when(~within_tolerance(actual["sq_m"], expected["sq_m"], TOLERANCE_PCT), "WRONG")
        .when(expected["basis"] != actual["basis"], "NEAR")
        .otherwise("CORRECT")
    )
    name = let(match_names(expected["text"], actual["raw"])["determination"], lambda d: F.when(d == "MATCH", "CORRECT").when(d == "PARTIAL_MATCH", "NEAR").otherwise("WRONG"))
    text = F.when(actual["cmp_key"] == F.lower(F.trim(expected["text"])), "CORRECT").when(alnum(actual["raw"]) == alnum(expected["text"]), "NEAR").otherwise("WRONG")
    return (
        F.when(kind == "money", same(expected["paise"], actual["paise"]))
        .when(kind == "date", same(expected["date_value"], actual["date_value"]))
        .when(kind == "parcel", same(squeezed(expected["text"]), squeezed(actual["raw"])))
        .when(kind == "area", area)
        .when(kind == "text", F.when(field.isin(*NAME_FIELDS), name).otherwise(text))
        .when(kind == "bool", same(F.lower(F.trim(expected["text"])).isin("true", "yes", "1"), actual["cmp_key"] == "true"))
        .otherwise("NOT_EVALUATED")
    )


def best_outcomes(truth: DataFrame, compared: DataFrame, keys: list[str]) -> DataFrame:
    """The best outcome of the candidates for each expected field; MISSING where there is none."""
    best = compared.groupBy(*keys).agg(F.min_by("outcome", rank(F.col("outcome"), OUTCOMES)).alias("outcome"))
    return truth.select(*keys).join(best, keys, "left").withColumn("outcome", F.coalesce("outcome", F.lit("MISSING")))


def extraction_outcomes(truth: DataFrame, extracted: DataFrame, keys: list[str]) -> DataFrame:
    """Outcomes of truth (keys, absent) against extracted (keys, outcome): a field said to be absent is SPURIOUS if found."""
    found = extracted.select(*keys).distinct()
    here = best_outcomes(truth.where("not absent"), extracted, keys)
    gone = truth.where("absent").select(*keys)
    spurious = gone.join(found, keys, "left_semi").withColumn("outcome", F.lit("SPURIOUS"))
    right = gone.join(found, keys, "left_anti").withColumn("outcome", F.lit("CORRECT"))
    return here.unionByName(spurious).unionByName(right)


def tally() -> list[Column]:
    """Aggregates of a column `outcome`, in one pass; sums of these are sums of parts."""
    return [F.count_if(F.col("outcome") == o).alias(o.lower()) for o in OUTCOMES]


def scored(counts: DataFrame) -> DataFrame:
    """counts with evaluated, attempted, precision, recall, f1, dangerous_error_rate and safe_failure_rate."""
    c = F.col
    attempted = c("correct") + c("near") + c("wrong") + c("spurious")
    out = counts.withColumns({"evaluated": attempted + c("missing"), "attempted": attempted, "precision": rate(c("correct"), attempted), "recall": rate(c("correct"), c("correct") + c("near") + c("wrong") + c("missing"))})
    return out.withColumns(
        {
            "f1": F.round(F.try_divide(2 * c("precision") * c("recall"), c("precision") + c("recall")), 4),
            "dangerous_error_rate": rate(c("wrong") + c("spurious"), c("evaluated")),
            "safe_failure_rate": rate(c("missing") + c("near"), c("evaluated")),
        }
    )


def extraction_scores(outcomes: DataFrame, field: str = "field") -> DataFrame:
    """Scores of each field and, with a null field, of all: one rollup."""
    return scored(outcomes.rollup(field).agg(*tally()))


def confusion(pairs: DataFrame) -> DataFrame:
    """How often each label was predicted for each expected one."""
    return pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def confusion_matrix(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """A row for each expected label, a column for each predicted one."""
    return pairs.groupBy("expected").pivot("predicted", labels).agg(F.count(F.lit(1))).na.fill(0)


def confusion_scores(cells: DataFrame) -> DataFrame:
    """Accuracy over what was decided, and how much was deferred; a deferral is no error."""
    decided = F.col("predicted") != DEFERRED
    right = decided & (F.col("expected") == F.col("predicted"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    sums = cells.agg(total(F.lit(True)).alias("total"), total(~decided).alias("deferred"), total(decided).alias("decided"), total(right).alias("correct"))
    return sums.withColumns({"accuracy_on_decided": rate(F.col("correct"), F.col("decided")), "deferral_rate": rate(F.col("deferred"), F.col("total")), "misclassification_rate": rate(F.col("decided") - F.col("correct"), F.col("total"))})


def top_confusions(cells: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent wrong answers; the limit is the report's."""
    return cells.where((F.col("expected") != F.col("predicted")) & (F.col("predicted") != DEFERRED)).orderBy(F.desc("n"), "expected", "predicted").limit(limit)


def finding_outcomes(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """expected (case_id, rule_id, determination, expect_clear) against findings.

    Absent is MISSING; an adverse finding where none may be is SPURIOUS; another determination is WRONG.
    """
    held = findings.select("case_id", "rule_id", F.col("determination").alias("got"))
    met = expected.join(held, ["case_id", "rule_id"], "left")
    adverse = F.col("got").isin("MISMATCH", "MISSING")
    outcome = F.when(F.col("got").isNull(), F.when(F.col("expect_clear"), "CORRECT").otherwise("MISSING")).when(F.col("expect_clear"), F.when(adverse, "SPURIOUS").otherwise("CORRECT")).when(F.col("got") == F.col("determination"), "CORRECT").otherwise("WRONG")
    return met.withColumn("outcome", outcome)


def dangerous(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome").isin("WRONG", "SPURIOUS"))


def ocr_scores(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean and 90th percentile of cer and wer; rows without a rate don't count."""
    p = lambda c: F.round(F.percentile(c, F.lit(0.9)), 4)
    return rows.groupBy(*keys).agg(F.count("cer").alias("n"), F.round(F.avg("cer"), 4).alias("mean_cer"), p("cer").alias("p90_cer"), F.round(F.avg("wer"), 4).alias("mean_wer"), p("wer").alias("p90_wer"))


def corpus_coverage(documents: DataFrame) -> DataFrame:
    """Labelled documents and types, and whether the corpus is too small to conclude from."""
    return documents.agg(F.count_distinct("case_id").alias("cases"), F.count("*").alias("documents"), F.count_distinct("document_type").alias("types")).withColumn("small_corpus", F.col("documents") < SMALL_CORPUS)


def unpivoted(scores: DataFrame, prefix: str) -> DataFrame:
    """metric and value of each numeric column of a one-row table."""
    names = [f.name for f in scores.schema.fields if f.dataType.typeName() in ("double", "long", "integer")]
    return scores.unpivot([], [F.col(n).cast("double").alias(n) for n in names], "metric", "value").withColumn("metric", F.concat(F.lit(prefix), "metric"))


def gate_table(spark: SparkSession, gates=GATES) -> DataFrame:
    return spark.createDataFrame(list(gates), "name string, metric string, direction string, threshold double, required boolean")


def check_gates(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """gates with value, passed and reason; what was not measured passes unless it is required."""
    met = gates.join(metrics, "metric", "left")
    holds = F.when(F.col("direction") == "max", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    passed = F.when(F.col("value").isNull(), ~F.col("required")).otherwise(holds)
    return met.withColumns({"passed": passed, "reason": F.when(F.col("value").isNull(), "not measured").when(holds, "holds").otherwise("fails")})


def all_metrics(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
