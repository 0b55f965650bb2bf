"""Integrity of a knowledge base: ids, references, readiness, files; counts and an exit code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _problem(rows: DataFrame, check: str, level: str, subject: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(level).alias("level"), subject.cast("string").alias("subject"))


def duplicate_ids(rows: DataFrame, ident: str, name: str) -> DataFrame:
    """Ids that occur twice, and rows without one."""
    twice = rows.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.count("*").alias("n")).where("n > 1")
    return _problem(twice, f"{name}: duplicate id", "error", F.col(ident)).unionByName(_problem(rows.where(F.col(ident).isNull()), f"{name}: missing id", "error", F.lit(None)))


def dangling(rows: DataFrame, reference: str, targets: DataFrame, ident: str, name: str) -> DataFrame:
    """References to what isn't there."""
    asked = rows.where(F.col(reference).isNotNull()).select(F.col(reference).alias("ref")).distinct()
    return _problem(asked.join(targets.select(F.col(ident).alias("ref")), "ref", "left_anti"), f"{name}: dangling reference", "error", F.col("ref"))


def violations(rows: DataFrame, subject: str, condition: Column, check: str, level: str = "error") -> DataFrame:
    """Rows on which an invariant fails."""
    return _problem(rows.where(condition), check, level, F.col(subject))


def difference(a: DataFrame, b: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """What one side has and the other hasn't; both frames have one column."""
    a, b = a.toDF("x").distinct(), b.toDF("x").distinct()
    only = lambda x, y, here, there: _problem(x.join(y, "x", "left_anti"), f"in {here}, not in {there}", "error", F.col("x"))
    return only(a, b, name_a, name_b).unionByName(only(b, a, name_b, name_a))


def rule_ready(requirements: DataFrame, instruments: DataFrame) -> DataFrame:
    """Requirements that are marked ready though their instrument is not verified; and those that still need a lawyer."""
    met = requirements.join(instruments.select(F.col("id").alias("source"), "verification_status"), "source", "left")
    early = violations(met, "id", (F.col("status") == "RULE_READY") & F.coalesce(F.col("verification_status") != "VERIFIED", F.lit(True)), "ready without a verified source")
    return early.unionByName(violations(met, "id", F.col("status") == "REQUIRES_LEGAL_REVIEW", "needs legal review", "warning"))


def report(*problems: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, problems)


def totals(problems: DataFrame) -> DataFrame:
    """errors, warnings and exit_code: 2 with errors, 1 with warnings, else 0."""
    out = problems.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    return out.withColumn("exit_code", F.when(F.col("errors") > 0, 2).when(F.col("warnings") > 0, 1).otherwise(0))
