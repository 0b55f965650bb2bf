"""Reviewers' decisions: an append-only log, its latest view, calibration, and corrections laid over extracted fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import areas, dates, money


def latest_feedback(log: DataFrame, keys: tuple[str, ...] = ("document_id", "field")) -> DataFrame:
    """The last decision on each field, combined before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("at", "ord") if "ord" in rest else F.col("at")).alias("l"))
    return last.select(*keys, "l.*")


def calibration(latest: DataFrame) -> DataFrame:
    """How often fields of each claimed confidence were corrected."""
    fixed = F.count_if(F.col("action") == "correct")
    out = latest.groupBy("original_confidence").agg(F.count("*").alias("reviewed"), fixed.alias("corrected"))
    return out.withColumn("correction_rate", F.round(F.try_divide("corrected", "reviewed"), 4))


def parse_correction(kind: Column, text: Column, original_basis: Column) -> Column:
    """A correction read as the field's own kind: key, paise, sq_m, basis, date_value, error. What can't be read is refused, not guessed."""
    figure = F.coalesce(money.money_figures(text)["paise"], money.figure_paise(F.when(text.rlike(r"^[\d,]+(\.\d{1,2})?$"), text)))
    day = F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), dates.parse_date(text)["value"])
    area = areas.parse_area(text)
    key = (
        F.when(kind == "money", figure.cast("string")).when(kind == "date", day.cast("string")).when(kind == "area", area["sq_m"].cast("string")).when(kind == "bool", F.when(F.lower(F.trim(text)).isin("true", "yes", "1"), "true").when(F.lower(F.trim(text)).isin("false", "no", "0"), "false")).otherwise(F.nullif(F.lower(F.trim(text)), F.lit("")))
    )
    basis = F.when(kind == "area", F.when(area["basis"] != "unspecified", area["basis"]).otherwise(original_basis))
    return F.struct(key.alias("cmp_key"), F.when(kind == "money", figure).alias("paise"), F.when(kind == "area", area["sq_m"]).alias("sq_m"), basis.alias("basis"), F.when(kind == "date", day).alias("date_value"), F.when(key.isNull(), F.concat(F.lit("unreadable as "), kind)).alias("error"))


def overlaid(fields: DataFrame, latest: DataFrame) -> DataFrame:
    """fields with accepted corrections in place: every value column that fields has, high confidence, human provenance and a
    note of what the document said; unreadable ones leave the field as it is.
    """
    fixed = latest.where("action = 'correct'").select("document_id", "field", "corrected_value")
    met = fields.join(fixed, ["document_id", "field"], "left").withColumn("c", parse_correction(F.col("kind"), F.col("corrected_value"), F.col("basis")))
    ok = F.col("corrected_value").isNotNull() & F.col("c.error").isNull()
    values = {c: F.col(f"c.{c}") for c in ("cmp_key", "paise", "sq_m", "basis", "date_value")}
    values |= {"display": F.trim("corrected_value"), "raw": F.trim("corrected_value"), "confidence": F.lit("HIGH")}
    said = F.concat(F.lit("corrected from "), F.coalesce(F.col("display") if "display" in fields.columns else F.col("cmp_key"), F.lit("nothing")))
    new = {c: F.when(ok, v).otherwise(F.col(c)) for c, v in values.items() if c in fields.columns}
    new["note"] = F.when(ok, said).otherwise(F.col("note") if "note" in fields.columns else F.lit(None).cast("string"))
    out = met.withColumns(new | {"provenance": F.when(ok, "human").otherwise("document")})
    return out.drop("c", "corrected_value")


def box_check(expected: Column, predicted: Column) -> Column:
    """OK where a file is what its box expects, ATTENTION where that can't be told, BLOCKED until confirmed otherwise."""
    return F.when((expected == "other") | (expected == predicted), "OK").when(predicted == "unknown", "ATTENTION").otherwise("BLOCKED")


def boxes(events: DataFrame) -> DataFrame:
    """What each box holds, from events (case_id, box, document_id, action, at). A box holds its last document; `other` holds all.

    A document that was removed, or moved on, is in no box or in the one it was moved to.
    """
    last = events.groupBy("case_id", "document_id").agg(F.max_by(F.struct("box", "action", "at"), "at").alias("e")).select("case_id", "document_id", "e.*").where("action <> 'remove'")
    single = last.where("box <> 'other'").groupBy("case_id", "box").agg(F.max_by(F.struct("document_id", "action", "at"), F.struct("at", "document_id")).alias("e"))
    return single.select("case_id", "box", "e.document_id", "e.action", "e.at").unionByName(last.where("box = 'other'").select("case_id", "box", "document_id", "action", "at"))


def rules_view(rules: DataFrame, findings: DataFrame, requirements: DataFrame) -> DataFrame:
    """Each rule with what its findings say and the requirements it cites."""
    said = findings.groupBy("rule_id").agg(F.count("*").alias("n_findings"), F.count_if(F.col("disposition") == "BLOCKER").alias("n_blockers"))
    cited = rules.select("rule_id", F.explode("citations").alias("id")).join(requirements.select("id", "status"), "id", "left")
    cites = cited.groupBy("rule_id").agg(F.array_sort(F.collect_list("id")).alias("cited"), F.count_if(F.col("status").isNull()).alias("n_unknown"))
    return rules.select("rule_id", "severity", "check").join(said, "rule_id", "left").join(cites, "rule_id", "left")


def regulatory_view(requirements: DataFrame, instruments: DataFrame) -> DataFrame:
    """Each requirement with its instrument, and why no rule may rest on it yet."""
    met = requirements.join(instruments.select(F.col("id").alias("source"), "title", "verification_status"), "source", "left")
    why = F.when(F.col("verification_status").isNull(), "instrument unknown").when(F.col("verification_status") != "VERIFIED", "instrument not verified").when(F.col("status") == "REQUIRES_LEGAL_REVIEW", "needs legal review")
    return met.withColumn("blocked_because", why)


def verification_view(planned: DataFrame, results: DataFrame) -> DataFrame:
    """Each case's sources: how they are asked, and what came back."""
    said = results.groupBy("case_id", "source_id").agg(F.count("*").alias("n_results"), F.array_sort(F.collect_set("status")).alias("statuses"))
    return planned.select("case_id", "source_id", "execution", "reason").join(said, ["case_id", "source_id"], "left")


def evaluation_view(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """Every metric, with its gate's verdict where it has one."""
    return metrics.join(gates.select("metric", "name", "passed", "reason"), "metric", "left")


def trace_view(claims: DataFrame, resolutions: DataFrame, findings: DataFrame) -> DataFrame:
    """Per case, how claims became findings: counts at each step."""
    a = claims.groupBy("case_id").agg(F.count("*").alias("claims"), F.count_distinct("document_id").alias("documents"))
    b = resolutions.groupBy("case_id").agg(F.count("*").alias("resolutions"), F.count_if(F.col("determination") == "MISMATCH").alias("conflicts"))
    c = findings.groupBy("case_id").agg(F.count("*").alias("findings"), F.count_if(F.col("disposition") == "BLOCKER").alias("blockers"))
    return a.join(b, "case_id", "full").join(c, "case_id", "full").na.fill(0)
