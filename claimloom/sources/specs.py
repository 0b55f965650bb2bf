"""Specifications in: rules, source registries and labelled corpora from YAML or JSON. A bad file is reported, not fatal."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.operators.rules import validated
from claimloom.operators.verify import SOURCE_SCHEMA, VERIFIED_ATTRIBUTE, mapped_terms, worse_tier

#: Days for which a source's record counts as fresh. Fixed values.
FRESHNESS = {"SRC_CERSAI": 30, "SRC_MAHARERA": 180, "SRC_MCGM_PTAX": 90, "SRC_PROPERTY_CARD_MH": 365}


def load(path: str) -> dict:
    """A YAML or JSON file."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need the yaml package; use JSON") from e
    return yaml.safe_load(text) or {}


def load_rules(path: str) -> list[dict]:
    """A checked rule set: ids are unique, approved rules signed off, checks known."""
    return validated(load(path).get("rules", []))


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """A source registry as rows: the worse tier of a range, verified terms as attributes, the authority's name (else its id)."""
    data = load(path)
    names = {a["id"]: a.get("name", a["id"]) for a in data.get("authorities") or []}
    rows = [
        (s["id"], int(s.get("priority", 99)), worse_tier(str(s.get("tier_preliminary", "T6"))), list(s.get("keyed_by") or []), mapped_terms(s.get("verifies") or [], VERIFIED_ATTRIBUTE), list(s.get("blocked_on") or []), FRESHNESS.get(s["id"]), names.get(s.get("authority"), s.get("authority") or "unknown"))
        for s in data.get("verification_sources") or []
    ]
    return spark.createDataFrame(rows, f"{SOURCE_SCHEMA}, authority string")


def load_corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Labelled fields (case_id, file, document_type, field, expected, absent) and files that couldn't be read (path, error)."""
    rows, bad = [], []
    for path in sorted(p for p in Path(folder).iterdir() if p.suffix in (".yaml", ".yml", ".json")):
        try:
            case = load(str(path))
            for doc in case.get("documents", []):
                rows += [(case["case_id"], doc["file"], doc.get("document_type"), f, json.dumps(v, default=str), False) for f, v in (doc.get("fields") or {}).items()]
                rows += [(case["case_id"], doc["file"], doc.get("document_type"), f, None, True) for f in doc.get("absent_fields") or []]
        except Exception as e:  # one bad file is a row of the report
            bad.append((str(path), str(e)))
    return spark.createDataFrame(rows, "case_id string, file string, document_type string, field string, expected string, absent boolean"), spark.createDataFrame(bad, "path string, error string")


def markdown_rows(lines: DataFrame) -> DataFrame:
    """Rows of numbered tables in Markdown lines (line_no, line): section, number, closed (struck out), text."""
    section = F.last(F.when(F.col("line").rlike(r"^#{1,6}\s"), F.regexp_replace("line", r"^#{1,6}\s+", "")), ignorenulls=True)
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(c))
    out = lines.withColumn("section", section.over(Window.orderBy("line_no"))).withColumn("cells", cells)
    number: Column = F.regexp_extract(F.get("cells", F.lit(1)), r"^~{0,2}(\d+)~{0,2}$", 1).try_cast("int")
    return out.where(F.col("line").startswith("|") & number.isNotNull()).select("section", number.alias("number"), F.get("cells", F.lit(1)).startswith("~").alias("closed"), F.get("cells", F.lit(2)).alias("text"))
