"""Document classification by weighted phrases, which may decline to answer.

Scores are integer milli-points, so that sums are exact. A signal counts on every page, less on later ones, up to twice its
weight.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- fixed values: name, pattern, type, milli-points, title only --------------------------
SIGNALS = (
    ("sale_deed_title", r"\b(deed\s+of\s+(sale|conveyance)|sale\s+deed|conveyance\s+deed)\b", "sale_deed", 10000, True),
    ("sale_deed_operative", r"\bhereby\s+(sell|sells|sold|grant|convey|transfer)s?\b.{0,80}\b(convey|transfer|assur)", "sale_deed", 8000, False),
    ("sale_deed_parties", r"\b(vendor|vendee)\b", "sale_deed", 3000, False),
    ("sale_deed_absolute", r"\babsolute(ly)?\s+(owner|seized|possessed)\b", "sale_deed", 2500, False),
    ("aos_title", r"\bagreement\s+(for|of|to)\s+sale\b", "agreement_of_sale", 10000, True),
    ("aos_agreement_to_sell", r"\bagreement\s+to\s+sell\b", "agreement_of_sale", 8000, True),
    ("aos_promoter_allottee", r"\b(promoter|allottee)\b", "agreement_of_sale", 4000, False),
    ("aos_maharera", r"\bmaha\s*rera\b|\bP\d{11,}\b", "agreement_of_sale", 3000, False),
    ("tax_title", r"\bproperty\s+tax\b", "property_tax", 9000, False),
    ("tax_mcgm", r"\bmunicipal\s+corporation\s+of\s+greater\s+mumbai\b|\bM\.?C\.?G\.?M\.?\b|\bB\.?M\.?C\.?\b", "property_tax", 5000, False),
    ("tax_assessment", r"\b(assessment\s+(no|number)|property\s+account\s+(no|number)|\bP\.?I\.?D\.?\b)", "property_tax", 5000, False),
    ("tax_rateable", r"\b(rateable\s+value|capital\s+value|bill\s+period)\b", "property_tax", 4000, False),
    ("possession_title", r"\bpossession\s+(letter|receipt|certificate)\b", "possession_document", 10000, True),
    ("possession_handover", r"\b(handed\s+over|handing\s+over|taken\s+over)\s+(the\s+)?(quiet\s+and\s+peaceful\s+)?possession\b", "possession_document", 7000, False),
    ("modt", r"\bmemorandum\s+of\s+(deposit|entry)\s+.{0,20}title\s+deeds?\b|\bM\.?O\.?D\.?T\.?\b", "mortgage_deed", 10000, True),
    ("mortgage_deed_title", r"\b(deed\s+of\s+mortgage|mortgage\s+deed|deed\s+of\s+simple\s+mortgage)\b", "mortgage_deed", 10000, True),
    ("mortgage_deposit", r"\bdeposit\s+of\s+title\s+deeds?\b", "mortgage_deed", 6000, False),
    ("index_ii", r"\bindex[\s\-]*(ii|2)\b", "registration_receipt", 10000, False),
    ("sub_registrar", r"\bsub[\s\-]?registrar\b", "registration_receipt", 3000, False),
    ("property_card", r"\bproperty\s+(register\s+)?card\b|\bmalmatta\s+patrak\b", "property_card", 10000, True),
    ("cts_number", r"\bC\.?T\.?S\.?\s*(no|number)?\b", "property_card", 3000, False),
    ("occupancy_certificate", r"\boccupancy\s+certificate\b|\bO\.?C\.?\s+granted\b", "occupancy_certificate", 10000, True),
    ("encumbrance_certificate", r"\bencumbrance\s+certificate\b", "encumbrance_certificate", 10000, True),
    ("mr_sale_deed", r"खरेदीखत", "sale_deed", 4000, False),
    ("mr_agreement", r"करारनामा", "agreement_of_sale", 4000, False),
    ("mr_property_tax", r"मालमत्ता\s*कर", "property_tax", 4000, False),
    ("mr_possession", r"ताबा", "possession_document", 3000, False),
    ("mr_mortgage", r"गहाण", "mortgage_deed", 3000, False),
)
TITLE_CHARS, MATCHED_CHARS = 1200, 120
MINIMUM, HIGH = 8_000, 16_000
LEAD = 1.5
CONFIDENCE_VALUE = {"HIGH": 0.9, "MEDIUM": 0.6, "LOW": 0.3, "INSUFFICIENT": 0.0}

Signal = tuple[str, str, str, int, bool]


def page_factor(page: Column) -> Column:
    """Twentieths that a hit counts on a page: all on the first, half on the second, little on later ones."""
    return F.when(page == 1, 20).when(page == 2, 10).otherwise(3)


def signal_hits(pages: DataFrame, signals: tuple[Signal, ...] = SIGNALS, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """keys, page, signal, ord, doc_type, weight, hits for signals that occur on a page.

    Each signal is a literal pattern in one projection, so patterns are compiled once and no join is needed.
    """
    counted = []
    for ord_, (name, pattern, kind, milli, title) in enumerate(signals):
        text = F.when(F.col("page") == 1, F.left("text", F.lit(TITLE_CHARS))) if title else F.col("text")
        hits = F.coalesce(F.regexp_count(text, F.lit(f"(?iu){pattern}")), F.lit(0))
        counted.append(F.struct(F.lit(ord_).alias("ord"), F.lit(name).alias("signal"), F.lit(kind).alias("doc_type"), F.lit(milli).cast("long").alias("weight"), hits.cast("long").alias("hits")))
    return pages.select(*keys, "page", F.explode(F.filter(F.array(*counted), lambda s: s["hits"] > 0)).alias("s")).select(*keys, "page", "s.*")


def signal_scores(hits: DataFrame, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Milli-points of each signal in each document: the sum over pages, at most twice the weight."""
    points = F.col("hits") * F.col("weight") * page_factor(F.col("page")) / 20
    return hits.groupBy(*keys, "signal", "ord", "doc_type", "weight").agg(F.least(F.max("weight") * 2, F.sum(points.cast("long"))).alias("points"))


def evidence(hits: DataFrame, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """hits with contribution: what a page adds, clipped at what the cap leaves after earlier pages."""
    points = (F.col("hits") * F.col("weight") * page_factor(F.col("page")) / 20).cast("long")
    before = Window.partitionBy(*keys, "signal").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0), F.col("weight") * 2 - F.coalesce(F.sum(points).over(before), F.lit(0)))
    return hits.withColumn("contribution", F.least(points, left))


def hit_evidence(pages: DataFrame, signals: tuple[Signal, ...] = SIGNALS, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """keys, page, signal, doc_type, place (from 1 within page and signal), matched_text and contribution of each hit that counts.

    A hit adds its weight by page until its signal's cap is reached; hits after that are left out.
    """
    found = []
    for name, pattern, kind, milli, title in signals:
        text = F.when(F.col("page") == 1, F.left("text", F.lit(TITLE_CHARS))) if title else F.col("text")
        hits = F.regexp_extract_all(text, F.lit(f"(?iu){pattern}"), F.lit(0))
        found.append(F.struct(F.lit(name).alias("signal"), F.lit(kind).alias("doc_type"), F.lit(milli).cast("long").alias("weight"), F.coalesce(F.transform(hits, lambda h: F.left(h, F.lit(MATCHED_CHARS))), F.array().cast("array<string>")).alias("hits")))
    held = pages.select(*keys, "page", F.explode(F.filter(F.array(*found), lambda s: F.size(s["hits"]) > 0)).alias("s"))
    each = held.select(*keys, "page", "s.signal", "s.doc_type", "s.weight", F.posexplode("s.hits").alias("place", "matched_text")).withColumn("place", F.col("place") + 1)
    points = (F.col("weight") * page_factor(F.col("page")) / 20).cast("long")
    before = Window.partitionBy(*keys, "signal").orderBy("page", "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0), F.col("weight") * 2 - F.coalesce(F.sum(points).over(before), F.lit(0)))
    return each.withColumn("contribution", F.least(points, left)).where("contribution > 0").drop("weight")


def type_scores(scores: DataFrame, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Milli-points of each type, with first_ord, its earliest signal."""
    return scores.groupBy(*keys, "doc_type").agg(F.sum("points").alias("points"), F.min("ord").alias("first_ord"))


def decide(documents: DataFrame, types: DataFrame, keys: tuple[str, ...] = ("document_id",), degraded: Column | None = None) -> DataFrame:
    """keys, doc_type, reason, confidence, best, runner_up, needs_human for each of documents (keys, has_text).

    No text, too few points, or a runner-up too close each give `unknown` with the reason and insufficient confidence.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("less"), "first_ord", "doc_type")))
    top = types.groupBy(*keys).agg(ranked.alias("r"))
    out = documents.join(top, list(keys), "left")
    best, second = F.coalesce(-F.get("r", F.lit(0))["less"], F.lit(0)), F.coalesce(-F.get("r", F.lit(1))["less"], F.lit(0))
    reason = F.when(~F.col("has_text"), "NO_TEXT").when(best < MINIMUM, "WEAK").when((second > 0) & (best < second * LEAD), "AMBIGUOUS")
    sure = F.when(reason.isNotNull(), "INSUFFICIENT").when(best >= HIGH, "HIGH").otherwise("MEDIUM")
    if degraded is not None:
        sure = F.when(degraded & (sure == "HIGH"), "MEDIUM").otherwise(sure)
    return out.select(
        *keys,
        F.when(reason.isNull(), F.get("r", F.lit(0))["doc_type"]).otherwise("unknown").alias("doc_type"),
        reason.alias("reason"),
        sure.alias("confidence"),
        best.cast("long").alias("best"),
        second.cast("long").alias("runner_up"),
        (reason.isNotNull() | sure.isin("LOW", "INSUFFICIENT")).alias("needs_human"),
    )


def classify(pages: DataFrame, signals: tuple[Signal, ...] = SIGNALS, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """decide() over pages (keys, page, text)."""
    documents = pages.groupBy(*keys).agg(F.coalesce(F.bool_or(F.length(F.trim("text")) > 0), F.lit(False)).alias("has_text"))
    return decide(documents, type_scores(signal_scores(signal_hits(pages, signals, keys), keys), keys), keys)


def applied(declared: Column, predicted: Column) -> Column:
    """A declared type stands; an unknown one is replaced by the prediction."""
    return F.coalesce(F.nullif(declared, F.lit("unknown")), predicted)


def signals_for(kind: str, signals: tuple[Signal, ...] = SIGNALS) -> tuple[Signal, ...]:
    """The signals of one document type."""
    return tuple(s for s in signals if s[2] == kind)


def known_types(signals: tuple[Signal, ...] = SIGNALS) -> tuple[str, ...]:
    """The document types that signals speak for, in order."""
    return tuple(dict.fromkeys(s[2] for s in signals))


def confidence_value(confidence: Column) -> Column:
    """A confidence tier as a number."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in CONFIDENCE_VALUE.items() for x in pair)), confidence)


def title_patterns(signals: tuple[Signal, ...] = SIGNALS) -> dict[str, re.Pattern]:
    """The signals as compiled patterns, for checks outside a plan."""
    return {name: re.compile(pattern, re.IGNORECASE) for name, pattern, *_ in signals}
