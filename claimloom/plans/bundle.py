"""Documents to findings in one plan, and a small bundle to show it on."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.model import EQUITABLE
from claimloom.operators import assemble, classify, extract, rules
from claimloom.operators.claims import resolve
from claimloom.plans.registry import query

#: One property in three documents, with a conflict about its area and two spellings of names. Invented.
BUNDLE = (
    ("bundle_sale_deed", 1, "DEED OF SALE\nThis Deed of Sale is executed on this 14th day of March 2024 BETWEEN\nShri Ramesh Patil, hereinafter called the VENDOR, of the One Part AND\nSmt. Anita Desai, hereinafter called the PURCHASER, of the Other Part.\nThe vendor doth hereby sell and convey the flat bearing C.T.S. No. 1234/5A.\nCarpet Area: 1150 sq ft\nConsideration: Rs. 1,25,00,000/- (Rupees One Crore Twenty Five Lakh only).\nRegistration No. BDR-4/3321/2024\nSub-Registrar of Assurances, Borivali"),
    ("bundle_agreement", 1, "AGREEMENT FOR SALE\nThis Agreement to Sell is executed on this 2nd day of January 2024 BETWEEN\nR. Patil, hereinafter called the PROMOTER, of the One Part AND\nAnita Dessai, hereinafter called the ALLOTTEE, of the Other Part.\nThe promoter agrees to sell the flat bearing C.T.S. No. 1234/5A to the allottee.\nCarpet Area: 1150 sq ft\nConsideration: Rs. 1,25,00,000/-\nMahaRERA No. P51900012345"),
    ("bundle_property_tax", 1, "PROPERTY TAX BILL\nMunicipal Corporation of Greater Mumbai\nAssessment No. A-1234567890\nC.T.S. No. 1234/5A\nCarpet Area: 980 sq ft\nRateable Value: Rs. 45,000"),
)


def bundle_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("CASE_1", d, p, t) for d, p, t in BUNDLE], "case_id string, document_id string, page int, text string")


def process(pages: DataFrame, cases: DataFrame, rule_set=rules.RULES) -> dict[str, DataFrame]:
    """All steps for all cases at once: documents, fields, claims, parties, resolutions, findings.

    pages: case_id, document_id, page, text. cases: case_id, lender_type, product, state, transaction_type, security_type, the
    loan's amounts, expected_documents, regulatory_as_of.
    """
    spark = pages.sparkSession
    keys = ("case_id", "document_id")
    # every later step reads these: they are computed once
    documents = classify.classify(pages, keys=keys).withColumnRenamed("doc_type", "document_type").persist()
    fields = extract.extract(documents, pages).persist()
    claims = extract.to_claims(fields).persist()
    parties = assemble.merge_parties(claims)
    resolutions = resolve(claims).persist()
    present = documents.groupBy("case_id").agg(F.array_sort(F.collect_set("document_type")).alias("present"))
    held = documents.select("case_id", "document_type", F.col("document_id").alias("ord"), F.lit("unknown").alias("custody"))
    none = spark.createDataFrame([], "case_id string, source_id string, attribute string, tier string, status string, external_value string")
    full = cases.join(present, "case_id", "left").withColumn("present", F.coalesce("present", F.array().cast("array<string>")))
    findings = rules.evaluate({"cases": full, "documents": held, "claims": claims, "resolutions": resolutions, "verification": none}, rule_set)
    return {"documents": documents, "fields": fields, "claims": claims, "parties": parties, "resolutions": resolutions, "findings": findings}


def bundle_cases(spark: SparkSession) -> DataFrame:
    row = ("CASE_1", "HFC", "housing_loan", "MH", "resale_purchase", EQUITABLE, 900_000_000, None, 1_250_000_000, ["sale_deed", "agreement_of_sale", "property_tax"], date(2024, 4, 1))
    return spark.createDataFrame(
        [row], "case_id string, lender_type string, product string, state string, transaction_type string, security_type string, sanctioned_paise long, outstanding_paise long, property_value_paise long, expected_documents array<string>, regulatory_as_of date"
    )


@query("""SELECT * FROM (VALUES ('bundle_agreement', 'agreement_of_sale'), ('bundle_property_tax', 'property_tax'), ('bundle_sale_deed', 'sale_deed')) t(document_id, document_type)""")
def bundle_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What the bundle's documents are."""
    return process(bundle_pages(spark), bundle_cases(spark))["documents"].select("document_id", "document_type")


@query("""SELECT * FROM (VALUES ('bundle_agreement', 7::BIGINT), ('bundle_property_tax', 4::BIGINT), ('bundle_sale_deed', 9::BIGINT)) t(document_id, n_fields)""")
def bundle_fields(spark: SparkSession, folder: str) -> DataFrame:
    """How many fields each document yields, grounded in its text."""
    return process(bundle_pages(spark), bundle_cases(spark))["claims"].groupBy("document_id").agg(F.count("*").alias("n_fields"))


@query("""SELECT * FROM (VALUES ('DOC_COMPLETENESS_001', 'MATCH', 'CLEARED'), ('XDOC_AREA_001', 'MISMATCH', 'BLOCKER'), ('XDOC_PARCEL_001', 'MATCH', 'CLEARED'), ('OWNERSHIP_001', 'NOT_DETERMINABLE', 'REVIEW_REQUIRED'),
 ('MORTGAGE_REG_001', 'NOT_APPLICABLE', 'NOT_APPLICABLE'), ('CUSTODY_001', 'MISMATCH', 'BLOCKER'), ('LTV_CAP_001', 'MATCH', 'CLEARED'), ('EXT_CERSAI_CHARGE_001', 'NOT_DETERMINABLE', 'REVIEW_REQUIRED'), ('EXT_OWNER_MATCH_001', 'NOT_DETERMINABLE', 'REVIEW_REQUIRED'),
 ('EXT_AREA_MATCH_001', 'NOT_DETERMINABLE', 'INFORMATIONAL'), ('EXT_COVERAGE_001', 'NOT_DETERMINABLE', 'INFORMATIONAL'), ('LTV_CONSIDERATION_001', 'MATCH', 'CLEARED')) t(rule_id, determination, disposition)""")
def bundle_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The whole rule set over the bundle: the area conflict blocks."""
    return process(bundle_pages(spark), bundle_cases(spark))["findings"].select("rule_id", "determination", "disposition")
