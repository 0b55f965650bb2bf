"""Extraction by document schema: which fields a document must and may have, where, and how many of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions.text import exact_span, ground_tier, located_span
from claimloom.model import STRENGTH_OF_DOCUMENT, mapped
from claimloom.operators import finders
from claimloom.operators.pages import block_at

# -- fixed values: document type, field, attribute, finder, required, select, pages ---------
_IDENTITY = (
    ("cts_number", "property.parcel_identifier", "cts_number", False, "DISTINCT", "ALL"),
    ("survey_number", "property.parcel_identifier", "survey_number", False, "DISTINCT", "ALL"),
    ("plot_number", "property.parcel_identifier", "plot_number", False, "DISTINCT", "ALL"),
    ("area", "property.area", "area", False, "DISTINCT", "ALL"),
)
_REGISTRATION = (
    ("registration_number", "registration.number", "registration_number", False, "FIRST", "LAST"),
    ("sub_registrar", "registration.sub_registrar", "sub_registrar", False, "FIRST", "LAST"),
)
SCHEMAS: dict[str, tuple[tuple, ...]] = {
    "sale_deed": (
        ("seller", "party.seller", "seller", True, "ALL", "FIRST"),
        ("buyer", "party.buyer", "buyer", True, "ALL", "FIRST"),
        ("owner", "party.owner", "buyer", False, "ALL", "FIRST"),
        ("consideration", "transaction.consideration", "consideration_amount", True, "DISTINCT", "ALL"),
        ("execution_date", "transaction.execution_date", "execution_date", True, "FIRST", "FIRST"),
        *_IDENTITY,
        *_REGISTRATION,
    ),
    "agreement_of_sale": (
        ("seller", "party.seller", "seller", True, "ALL", "FIRST"),
        ("buyer", "party.buyer", "buyer", True, "ALL", "FIRST"),
        ("consideration", "transaction.consideration", "consideration_amount", True, "DISTINCT", "ALL"),
        ("agreement_date", "transaction.agreement_date", "execution_date", True, "FIRST", "FIRST"),
        ("maharera_number", "project.rera_registration_number", "maharera_number", False, "DISTINCT", "ALL"),
        *_IDENTITY,
        *_REGISTRATION,
    ),
    "property_tax": (
        ("assessment_number", "tax.assessment_number", "assessment_number", True, "DISTINCT", "ALL"),
        ("assessee", "party.assessee", "parties", False, "ALL", "ALL"),
        ("amount", "tax.amount", "consideration", False, "DISTINCT", "ALL"),
        ("bill_date", "tax.bill_date", "dates", False, "FIRST", "ALL"),
        *_IDENTITY,
    ),
    "possession_document": (
        ("possession_date", "possession.date", "execution_date", True, "FIRST", "ALL"),
        ("recipient", "party.buyer", "parties", False, "ALL", "ALL"),
        *_IDENTITY,
    ),
    "mortgage_deed": (
        ("mortgagor", "party.mortgagor", "seller", False, "ALL", "FIRST"),
        ("mortgagee", "party.mortgagee", "buyer", False, "ALL", "FIRST"),
        ("secured_amount", "security.amount", "consideration_amount", False, "DISTINCT", "ALL"),
        ("execution_date", "security.execution_date", "execution_date", False, "FIRST", "FIRST"),
        *_IDENTITY,
        *_REGISTRATION,
    ),
}
HIGH_AT, MEDIUM_AT = 0.90, 0.70
DOC = ["case_id", "document_id"]


def schema_fields(spark: SparkSession) -> DataFrame:
    """The schemas as a table."""
    rows = [(kind, i, *spec) for kind, specs in SCHEMAS.items() for i, spec in enumerate(specs)]
    return spark.createDataFrame(rows, "document_type string, field_ord int, field string, attribute string, finder string, required boolean, select string, scope string")


def in_scope(pages: DataFrame) -> DataFrame:
    """Readable pages with is_first and is_last, among a document's readable pages."""
    doc = Window.partitionBy(*DOC)
    readable = pages.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    return readable.withColumns({"is_first": F.col("page") == F.min("page").over(doc), "is_last": F.col("page") == F.max("page").over(doc)})


def field_confidence(ocr_confidence: Column, note: Column) -> Column:
    """LOW for a contradiction; HIGH for a text layer; else by the recogniser's confidence."""
    return (
        F.when(note == "figures and words differ", "LOW").when(ocr_confidence.isNull() | (ocr_confidence >= HIGH_AT), "HIGH").when(ocr_confidence >= MEDIUM_AT, "MEDIUM").otherwise("LOW")
    )


def candidates(pages: DataFrame) -> DataFrame:
    """Every finder's matches on readable pages, with values; sellers and buyers are parties in those roles."""
    spans = finders.finder_spans(pages.select(*DOC, "page", "text"))
    amounts = finders.anchored_amounts(pages.select(*DOC, "page", "text"), spans)
    found = finders.valued(spans)
    roles = lambda name, held: found.where(F.col("finder") == "parties").where(F.col("role").isin(*held)).withColumn("finder", F.lit(name))
    chosen = finders.valued(amounts).withColumn("finder", F.lit("consideration_amount"))
    return found.unionByName(roles("seller", finders.SELLER_ROLES)).unionByName(roles("buyer", finders.BUYER_ROLES)).unionByName(chosen)


def extract(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Fields of documents (case_id, document_id, document_type) from pages (case_id, document_id, page, text[, confidence]).

    A row for each candidate that the field's selection keeps, grounded or not: field, attribute, value columns, page, tier and
    provenance (span and the words around it). Selection precedes grounding, so a first candidate that is not on the page
    yields nothing.
    """
    spark = documents.sparkSession
    scoped = in_scope(pages)
    if "confidence" not in pages.columns:
        scoped = scoped.withColumn("confidence", F.lit(None).cast("double"))
    fields = documents.select(*DOC, "document_type").join(F.broadcast(schema_fields(spark)), "document_type")
    found = candidates(scoped).join(scoped.select(*DOC, "page", "is_first", "is_last", "confidence", F.col("text").alias("page_text")), [*DOC, "page"])
    met = fields.join(found, [*DOC, "finder"]).where((F.col("scope") == "ALL") | ((F.col("scope") == "FIRST") & F.col("is_first")) | ((F.col("scope") == "LAST") & F.col("is_last")))
    order = [F.col("page"), F.col("start")]
    first = F.row_number().over(Window.partitionBy(*DOC, "field").orderBy(*order))
    same = F.row_number().over(Window.partitionBy(*DOC, "field", "kind", "cmp_key").orderBy(*order))
    met = met.withColumns({"_first": first, "_same": same})
    kept = met.where((F.col("select") == "ALL") | ((F.col("select") == "FIRST") & (F.col("_first") == 1)) | ((F.col("select") == "DISTINCT") & (F.col("_same") == 1)))
    kept = kept.withColumn("tier", ground_tier(F.col("page_text"), F.col("raw")))
    kept = kept.withColumn("provenance", provenance(F.col("page_text"), F.col("start"), F.col("end")))
    return kept.withColumn("field_confidence", field_confidence(F.col("confidence"), F.col("note"))).drop("_first", "_same", "is_first", "is_last", "scope", "select", "page_text")


def grounded(fields: DataFrame) -> DataFrame:
    return fields.where("tier is not null")


def ground_anywhere(values: DataFrame, pages: DataFrame) -> DataFrame:
    """values (case_id, document_id, page, raw, ...), as an outside extractor claims them, with tier, found_page, start and end.

    A value is looked for on the page that is claimed for it, then on the document's other pages in order; the first page that
    holds it in any way counts. What stands nowhere in its document has no tier. A document's pages meet its own values alone.
    """
    rows = values.withColumn("_value", F.monotonically_increasing_id())
    met = rows.select("_value", *DOC, F.col("page").alias("_claimed"), F.col("raw").alias("_raw")).join(pages.select(*DOC, F.col("page").alias("_page"), F.col("text").alias("_text")), DOC)
    held = met.withColumn("tier", ground_tier(F.col("_text"), F.col("_raw"))).where("tier is not null")
    order = F.struct((F.col("_page") != F.coalesce("_claimed", F.lit(-1))).alias("away"), F.col("_page"))
    best = held.groupBy("_value").agg(F.min_by(F.struct("_page", "tier", "_text", "_raw"), order).alias("b"))
    exact = exact_span(F.col("b._text"), F.col("b._raw"))
    best = best.withColumn("span", F.when(F.col("b.tier") == "exact", F.struct(exact["start"].cast("int").alias("start"), exact["end"].cast("int").alias("end"))).otherwise(located_span("b._text", "b._raw")))
    found = best.select("_value", "b.tier", F.col("b._page").alias("found_page"), "span.start", "span.end")
    return rows.join(found, "_value", "left").drop("_value")


def rejected_ungrounded(fields: DataFrame) -> DataFrame:
    return fields.where("tier is null")


def provenance(text: Column, start: Column, end: Column, blocks: Column | None = None, reach: int = 60, most: int = 240) -> Column:
    """Where a value stands: its span, the words around it, and the block that holds its start."""
    first = F.greatest(start - reach, F.lit(0))
    around = F.left(F.substr(text, first + 1, end + reach - first), F.lit(most))
    return F.struct(start.alias("start"), end.alias("end"), around.alias("snippet"), (block_at(blocks, start)["at"] if blocks is not None else F.lit(None)).alias("box"))


def missing_required(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """Required fields of each document's schema that nothing grounded was found for."""
    required = documents.select(*DOC, "document_type").join(F.broadcast(schema_fields(documents.sparkSession).where("required")), "document_type")
    return required.join(grounded(fields).select(*DOC, "field").distinct(), [*DOC, "field"], "left_anti").groupBy(*DOC).agg(F.array_sort(F.collect_list("field")).alias("missing"))


def without_schema(documents: DataFrame) -> DataFrame:
    """Documents of types that nothing is extracted from."""
    return documents.where(~F.col("document_type").isin(*SCHEMAS))


def to_claims(fields: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Claims of grounded fields, in a fixed order within their case; the subject is the case's property."""
    kept = grounded(fields)
    if only:
        kept = kept.where(F.col("attribute").isin(*only))
    order = Window.partitionBy("case_id").orderBy("document_id", "field_ord", "page", "start")
    return kept.select(
        "case_id",
        F.concat(F.lit("PROP_"), F.left(F.sha2("case_id", 256), F.lit(12))).alias("subject_id"),
        "attribute",
        F.concat(F.lit("CLM_"), F.left(F.sha2(F.concat_ws("|", "case_id", "document_id", "field", "page", "start"), 256), F.lit(12))).alias("claim_id"),
        F.row_number().over(order).cast("long").alias("ord"),
        "kind",
        "cmp_key",
        "display",
        "paise",
        "sq_m",
        F.coalesce("basis", F.lit("unspecified")).alias("basis"),
        "date_value",
        "document_id",
        "page",
        "start",
        "end",
        F.col("field_confidence").alias("confidence"),
        mapped(F.col("document_type"), STRENGTH_OF_DOCUMENT, "non_probative").alias("strength"),
        F.lit(None).cast("string").alias("supersedes"),
    )
