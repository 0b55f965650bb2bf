"""Operators on small tables: what they decide, and what they decline to decide."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimloom.functions import text
from claimloom.functions.names import match_names, split_name
from claimloom.model import DETERMINACIES, DETERMINATIONS, DISPOSITIONS, EQUITABLE, SEVERITIES
from claimloom.operators import assemble, classify, claims, evaluate, extract, feedback, finders, ingest, integrity, pages, rules, survey, verify
from claimloom.plans import bundle

CLAIM = "case_id string, subject_id string, attribute string, claim_id string, ord long, kind string, cmp_key string, sq_m decimal(28,6), basis string, strength string, supersedes string"


def claim(i, key, attribute="a", kind="text", sq_m=None, basis="unspecified", strength="title_transferring", supersedes=None):
    return ("c", "s", attribute, f"id{i}", i, kind, key, None if sq_m is None else Decimal(str(sq_m)), basis, strength, supersedes)


def resolved(spark, *rows, **more):
    return {r["attribute"]: r for r in claims.resolve(spark.createDataFrame(list(rows), CLAIM), **more).collect()}


def test_resolution_outcomes(spark):
    asked = spark.createDataFrame([("c", "s", x) for x in ("none", "lone", "same", "split")], "case_id string, subject_id string, attribute string")
    got = resolved(spark, claim(1, "x", "lone"), claim(2, "x", "same"), claim(3, "x", "same"), claim(4, "x", "split"), claim(5, "y", "split"), claim(6, "y", "split"), required=asked)
    assert {k: r["determination"] for k, r in got.items()} == {"none": "MISSING", "lone": "NOT_DETERMINABLE", "same": "MATCH", "split": "MISMATCH"}
    assert (got["split"]["value"], got["split"]["largest"], got["split"]["dissent"]) == ("y", 2, 1)
    assert [got[k]["confidence"] for k in ("none", "lone", "same", "split")] == ["INSUFFICIENT", "LOW", "HIGH", "INSUFFICIENT"]


def test_ties_go_to_the_earliest_value(spark):
    assert resolved(spark, claim(2, "b"), claim(1, "z"))["a"]["value"] == "z"


def test_area_groups_follow_their_first_member(spark):
    area = lambda i, v, basis="carpet": claim(i, str(v), kind="area", sq_m=v, basis=basis)
    chain = resolved(spark, area(1, 100), area(2, 101.5), area(3, 103))["a"]
    assert (chain["n_clusters"], chain["largest"]) == (2, 2)  # 103 agrees with 101.5, not with 100
    assert resolved(spark, area(1, 100), area(2, 100, "built_up"))["a"]["determination"] == "MISMATCH"
    assert resolved(spark, area(1, 100), area(2, 101, "unspecified"))["a"]["determination"] == "MATCH"
    assert resolved(spark, area(1, 100), claim(2, "100"))["a"]["n_clusters"] == 2


def test_superseded_claims_go(spark):
    frame = spark.createDataFrame([claim(1, "x"), claim(2, "y", supersedes="id1"), claim(3, "z", "b", supersedes="id2")], CLAIM)
    assert {r["claim_id"] for r in claims.active(frame).collect()} == {"id2", "id3"}  # id2 is superseded in another set only


def test_ownership_needs_a_fitting_instrument(spark):
    frame = spark.createDataFrame([claim(1, "x", strength="contractual"), claim(2, "y", strength="administrative")], CLAIM)
    assert [r["claim_id"] for r in claims.ownership_only(frame).collect()] == ["id2"]


def test_supporting_and_conflicting_ids(spark):
    frame = spark.createDataFrame([claim(1, "x"), claim(2, "x"), claim(3, "y")], CLAIM)
    got = claims.supporting_ids(frame, claims.resolve(frame)).first()
    assert (got["supporting"], got["conflicting"]) == (["id1", "id2"], ["id3"])


def test_keys(spark):
    row = spark.range(1).select(claims.parcel_key(F.lit("CTS"), F.lit(" 12 / 5a -"), F.lit(None)).alias("k"), claims.comparable_text(F.lit(" Ab "), F.lit("")).alias("t"), claims.share_identifier(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("a"))).alias("o")).first()
    assert (row["k"], row["t"], row["o"]) == ("CTS|12/5A|", "ab", True)


def test_custody_and_latest(spark):
    docs = spark.createDataFrame([("c", "deed", "original_held", "OK"), ("c", "tax", "photocopy", "REJECTED")], "case_id string, document_type string, custody string, quality string")
    got = claims.custody_inventory(docs).first()
    assert (got["n_documents"], got["n_originals"], got["n_usable"], got["present"], got["originals"]) == (2, 1, 1, ["deed", "tax"], ["deed"])
    assert claims.latest(docs, ["case_id"], [F.desc("document_type")]).first()["document_type"] == "tax"


def test_disposition_table_is_total(spark):
    grid = [(d, s, c) for d in DETERMINATIONS for s in SEVERITIES for c in DETERMINACIES]
    rows = spark.createDataFrame(grid, "d string, s string, c string").select("d", "s", "c", rules.disposition(F.col("d"), F.col("s"), F.col("c")).alias("x")).collect()
    assert all(r["x"] in DISPOSITIONS for r in rows)
    assert not [r for r in rows if r["x"] == "BLOCKER" and (r["d"] not in ("MISMATCH", "MISSING") or r["c"] not in ("DETERMINISTIC", "EXTERNAL_VERIFIED"))]
    assert {r["x"] for r in rows if r["d"] == "PARTIAL_MATCH"} == {"CLEARED"}


def test_rule_set_is_checked():
    with pytest.raises(ValueError):
        rules.validated([*rules.RULES, rules.RULES[0]])
    with pytest.raises(ValueError):
        rules.validated([{**rules.RULES[0], "status": "APPROVED"}])
    with pytest.raises(KeyError):
        rules.validated([{**rules.RULES[0], "check": "no_such"}])
    with pytest.raises(ValueError):
        rules.predicate("documents_present")(lambda t, p: None)


def test_slab_bounds_belong_to_their_slab(spark):
    slabs = next(r for r in rules.RULES if r["rule_id"] == "LTV_CAP_001")["params"]["slabs"]
    rows = spark.createDataFrame([(300_000_000,), (300_000_100,), (750_000_000,), (750_000_100,)], "x long").select(rules.slab_cap(F.col("x"), slabs).alias("c")).collect()
    assert [r["c"] for r in rows] == [90, 80, 80, 75]
    cases = spark.createDataFrame([(255, 300, 90), (271, 300, 90), (1, 0, 90), (None, 1, 90)], "n long, v long, c int").select(rules.within_cap(F.col("n"), F.col("v"), F.col("c")).alias("d")).collect()
    assert [r["d"] for r in cases] == ["MATCH", "MISMATCH", "NOT_DETERMINABLE", "NOT_DETERMINABLE"]


def test_sniff_and_scan(spark):
    files = [("a.pdf", b"%PDF-1.4 x %%EOF\n"), ("b.png", b"%PDF-1.4 /JS /OpenAction %%EOF"), ("c.jpg", b"\xff\xd8\xff.."), ("d.tif", b"II*\x00"), ("e.pdf", b"hello"), ("f.pdf", b"%PDF-1.4 cut"), ("g.pdf", b"%PDF-1.4 /AA %%EOF")]
    got = {r["filename"]: r for r in ingest.scan(spark.createDataFrame([(n, bytearray(c)) for n, c in files], "filename string, content binary")).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {"a.pdf": "SAFE", "b.png": "BLOCKED", "c.jpg": "SAFE", "d.tif": "SAFE", "e.pdf": "BLOCKED", "f.pdf": "SUSPICIOUS", "g.pdf": "SUSPICIOUS"}
    assert got["b.png"]["safety_codes"] == ["EXTENSION_MISMATCH", "PDF_JAVASCRIPT", "PDF_OPEN_ACTION"]
    assert got["e.pdf"]["safety_codes"] == ["UNRECOGNISED_FORMAT"]


def test_duplicates_and_routes(spark):
    rows = spark.createDataFrame([("c", 1, "d1", "h", "SAFE"), ("c", 2, "d2", "h", "SAFE"), ("k", 1, "d3", "h", "SUSPICIOUS"), ("k", 2, "d4", "i", "BLOCKED")], "case_id string, arrival int, document_id string, sha256 string, verdict string")
    got = {r["document_id"]: r for r in ingest.route(ingest.duplicates(rows), allow_suspicious=False).collect()}
    assert {k: r["skip_reason"] for k, r in got.items()} == {"d1": None, "d2": "duplicate", "d3": "suspicious", "d4": "blocked"}
    assert got["d2"]["duplicate_of"] == "d1"


def test_quality_gate(spark):
    schema = "id int, ok boolean, encrypted boolean, page_count int, text_layer string, min_dpi double, median_sharpness double, rotated_pages int, distinct_page_sizes int"
    rows = [(0, True, False, 3, "DIGITAL", None, None, 0, 1), (1, False, True, 0, "UNKNOWN", None, None, 0, 0), (2, True, False, 900, "DIGITAL", None, None, 0, 1), (3, True, False, 2, "SCANNED", 90.0, 8.0, 1, 2), (4, True, False, 2, "SCANNED", None, None, 0, 1), (5, True, False, 2, "MIXED", 150.0, 90.0, 0, 1), (6, True, False, 0, "UNKNOWN", None, None, 0, 0)]
    got = {r["id"]: (r["quality"], r["quality_notes"]) for r in ingest.quality_gate(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        0: ("OK", []),
        1: ("REJECTED", ["ENCRYPTED"]),
        2: ("REJECTED", ["TOO_MANY_PAGES"]),
        3: ("DEGRADED", ["VERY_LOW_RESOLUTION", "BLURRY", "ROTATED_PAGES", "MIXED_PAGE_SIZES"]),
        4: ("DEGRADED", ["UNMEASURED_SHARPNESS", "NO_TEXT_AND_LOW_RESOLUTION"]),
        5: ("DEGRADED", ["LOW_RESOLUTION", "PARTIAL_TEXT_LAYER"]),
        6: ("REJECTED", ["NO_PAGES"]),
    }


def test_pages(spark):
    blocks = spark.createDataFrame([("d", "second", 0.0, 20.0, 1.0, 0.5), ("d", "first", 0.0, 10.04, 1.0, None), ("d", " ", 0.0, 5.0, 1.0, 0.1), ("d", "right", 5.0, 10.0, 9.0, 0.9)], "id string, text string, x0 double, y0 double, x1 double, confidence double").withColumn("y1", F.col("y0") + 5)
    got = pages.assembled(blocks, "id").first()
    assert got["text"] == "first\nright\nsecond"
    assert [(b["char_start"], b["char_end"]) for b in got["blocks"]] == [(0, 5), (6, 11), (12, 18)]
    assert (got["mean_confidence"], got["min_confidence"]) == (0.7, 0.5)
    at = pages.assembled(blocks, "id").select(pages.block_at(F.col("blocks"), F.lit(6)).alias("b"), F.size(pages.blocks_for_span(F.col("blocks"), F.lit(4), F.lit(7))).alias("n")).first()
    assert (at["b"]["text"], at["n"]) == ("right", 2)
    texts = spark.createDataFrame([("x" * 25,), ("short",), (None,)], "text string")
    assert [r["source"] for r in pages.routed(texts).collect()] == ["text_layer", "ocr", "ocr"]
    assert [r["source"] for r in pages.routed(texts, ocr_available=False).collect()] == ["text_layer", "empty", "empty"]


def test_recognition_fails_by_page(spark):
    def engine(data):
        if data == b"bad":
            raise ValueError("broken page")
        return [{"text": "t", "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "confidence": 0.9}]

    frame = spark.createDataFrame([("d", 1, bytearray(b"ok")), ("d", 2, bytearray(b"bad"))], "document_id string, page int, content binary")
    got = {r["page"]: r for r in pages.recognised(frame, engine).collect()}
    assert got[1]["blocks"][0]["text"] == "t" and got[2]["error"] == "broken page"
    assert pages.recognised(frame, None).first()["error"] == "no engine"
    todo = pages.pending_ocr(spark.createDataFrame([("h", 1, "e", 200, "ocr"), ("h", 2, "e", 200, "ocr")], "sha256 string, page int, engine string, dpi int, source string"), spark.createDataFrame([("h", 1, "e", 200)], "sha256 string, page int, engine string, dpi int"))
    assert [r["page"] for r in todo.collect()] == [2]


def classified(spark, *page_texts):
    frame = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(page_texts)], "document_id string, page int, text string")
    return classify.classify(frame).first()


def test_classification(spark):
    assert classified(spark, "DEED OF SALE between the vendor and the vendee")["doc_type"] == "sale_deed"
    assert (classified(spark, "", " ")["doc_type"], classified(spark, "")["reason"]) == ("unknown", "NO_TEXT")
    assert classified(spark, "lorem ipsum")["reason"] == "WEAK"
    assert classified(spark, "DEED OF SALE and AGREEMENT FOR SALE")["reason"] == "AMBIGUOUS"
    assert classified(spark, "nothing", "x", "DEED OF SALE")["reason"] == "WEAK"  # a title counts on the first page alone
    many = classified(spark, "property tax " * 50)
    assert (many["best"], many["confidence"]) == (18000, "HIGH")  # twice the weight, however often
    assert classified(spark, "मालमत्ता कर")["reason"] == "WEAK"


def test_evidence_is_clipped_at_the_cap(spark):
    frame = spark.createDataFrame([("d", 1, "property tax"), ("d", 2, "property tax property tax property tax"), ("d", 3, "property tax")], "document_id string, page int, text string")
    got = [(r["page"], r["contribution"]) for r in classify.evidence(classify.signal_hits(frame)).where("signal = 'tax_title'").orderBy("page").collect()]
    assert got == [(1, 9000), (2, 9000), (3, 0)]


PAGE = "case_id string, document_id string, page int, text string"


def found(spark, text):
    frame = spark.createDataFrame([("c", "d", 1, text)], PAGE)
    return frame, finders.valued(finders.finder_spans(frame))


def test_anchored_amounts(spark):
    text = "Municipal deposit Rs. 9,99,00,000. Consideration: Rs. 1,25,00,000 and stamp duty Rs. 5,000"
    frame, _ = found(spark, text)
    got = finders.valued(finders.anchored_amounts(frame, finders.finder_spans(frame))).collect()
    assert [r["paise"] for r in got] == [1_250_000_000]
    frame, _ = found(spark, "Rs. 70,000 by way of consideration")
    assert [r["paise"] for r in finders.valued(finders.anchored_amounts(frame, finders.finder_spans(frame))).collect()] == [7_000_000]


def test_finders(spark):
    text = "C.T.S. No. 1234/5A, Survey No. 145, Plot No. B-7\nRegistration No. BDR-4/3321/2024\nP51900012345\nSub-Registrar of Assurances, Borivali\nCarpet: 10 sq ft and\n20 sq ft built\nexecuted on the 14th day of\nMarch 2024"
    got = {}
    for r in found(spark, text)[1].collect():
        got.setdefault(r["finder"], []).append(r)
    assert got["cts_number"][0]["cmp_key"] == "CTS|1234/5A|"
    assert got["survey_number"][0]["cmp_key"] == "SURVEY|145|"
    assert got["registration_number"][0]["display"] == "BDR-4/3321/2024"
    assert got["maharera_number"][0]["display"] == "P51900012345"
    assert got["sub_registrar"][0]["display"].startswith("Borivali")
    assert [r["basis"] for r in got["area"]] == ["carpet", "unspecified"]
    assert str(got["execution_date"][0]["date_value"]) == "2024-03-14"


def test_parties(spark):
    rows = found(spark, "BETWEENRameshPatil hereinaftercalledthe VENDOR of the One Part AND Smt. Anita Desai, hereinafter referred to as the PURCHASER")[1].where("finder = 'parties'").orderBy("start").collect()
    assert [(r["display"], r["role"]) for r in rows] == [("RameshPatil", "vendor"), ("Smt. Anita Desai", "purchaser")]


def test_conflicting_words_lower_confidence(spark):
    got = found(spark, "Consideration Rs. 1,00,000 (Rupees Two Lakh only)")[1].where("finder = 'consideration'").first()
    assert got["note"] == "figures and words differ"
    conf = spark.range(1).select(extract.field_confidence(F.lit(0.95), F.lit(got["note"])).alias("a"), extract.field_confidence(F.lit(None).cast("double"), F.lit(None).cast("string")).alias("b"), extract.field_confidence(F.lit(0.8), F.lit("x")).alias("c")).first()
    assert (conf["a"], conf["b"], conf["c"]) == ("LOW", "HIGH", "MEDIUM")


@pytest.fixture(scope="module")
def processed(spark):
    return bundle.process(bundle.bundle_pages(spark), bundle.bundle_cases(spark))


def test_bundle(processed):
    parties = processed["parties"].collect()
    assert len(parties) == 3
    assert sorted(len(p["variants"]) for p in parties) == [1, 2, 2]
    claimed = processed["claims"]
    assert claimed.count() == 20
    area = processed["resolutions"].where("attribute = 'property.area'").first()
    assert (area["determination"], area["n_clusters"], area["largest"]) == ("MISMATCH", 2, 2)
    assert extract.missing_required(processed["documents"], processed["fields"]).count() == 0
    assert extract.rejected_ungrounded(processed["fields"]).count() == 0
    assert extract.without_schema(processed["documents"]).count() == 0
    summary = rules.summarise(processed["findings"]).first()
    assert (summary["total"], summary["blockers"], summary["advisory"]) == (12, 2, 12)
    assert processed["findings"].orderBy(*rules.finding_order()).first()["disposition"] == "BLOCKER"
    notes = assemble.assembly_notes(processed["documents"], claimed, extract.missing_required(processed["documents"], processed["fields"]), extract.rejected_ungrounded(processed["fields"]))
    assert notes.count() == 0
    assert assemble.distinct_parties(processed["parties"]).first()["n_parties"] == 3


def test_parties_never_merge_through_a_third(spark):
    rows = [("c", "party.owner", i, n, f"id{i}") for i, n in enumerate(("Ramesh Patil", "Ramesh Patal", "Suresh Kulkarni", "R. Patil"))]
    got = assemble.merge_parties(spark.createDataFrame(rows, "case_id string, attribute string, ord int, display string, claim_id string")).orderBy("party_no").collect()
    assert sum(len(r["claim_ids"]) for r in got) == 4
    assert "Suresh Kulkarni" in {r["variants"][0] for r in got}


def test_planner_discloses_one_undisputed_key(spark):
    known = [("c", "s", "property.parcel_identifier", "MISMATCH", "CTS 1"), ("c", "s", "party.owner", "MATCH", "A")]
    planned = verify.plan(spark.createDataFrame([("c", "MH"), ("x", "GJ")], "case_id string, state string"), spark.createDataFrame(known, "case_id string, subject_id string, attribute string, determination string, value string"), verify.source_table(spark))
    got = {r["source_id"]: r for r in planned.collect()}
    assert len(got) == 5
    cersai = got["SRC_CERSAI"]
    assert (cersai["execution"], cersai["lookup_key"], cersai["ambiguous"]) == ("AUTOMATED", "borrower_identifiers", ["property_identifiers"])
    assert got["SRC_MAHARERA"]["execution"] == "SKIP"
    assert verify.worse_tier("T1_OR_T2") == "T2" and verify.worse_tier("T4_OR_T5") == "T5"
    assert verify.mapped_terms(["existing_charges", "encumbrance", "nonsense"], verify.VERIFIED_ATTRIBUTE) == ["property.encumbrance"]
    assert verify.manual_tasks(planned).count() == 0


VALUE = "struct<kind:string,cmp_key:string,raw:string,sq_m:decimal(28,6),basis:string>"


def test_orchestration(spark):
    planned = spark.createDataFrame(
        [("c", "A", "T2", 30, "AUTOMATED", ["party.owner", "project.name"]), ("c", "M", "T4", None, "MANUAL", ["party.owner"]), ("c", "S", "T5", None, "SKIP", ["party.owner"]), ("c", "D", "T2", None, "AUTOMATED", ["party.owner"])],
        "case_id string, source_id string, tier string, freshness_days int, execution string, attributes array<string>",
    )
    text = lambda raw: ("text", raw.lower(), raw, None, "unspecified")
    seen = spark.createDataFrame(
        [("c", "A", "party.owner", True, None, datetime(2024, 1, 1), text("R. Patil")), ("c", "A", "project.name", True, None, datetime(2024, 1, 1), text("Green Acres Phase 2"))],
        f"case_id string, source_id string, attribute string, record_found boolean, record_as_of timestamp, retrieved_at timestamp, external {VALUE}",
    )
    own = spark.createDataFrame([("c", "party.owner", "MISMATCH", text("Ramesh Patil")), ("c", "project.name", "MATCH", text("Green Acres"))], f"case_id string, attribute string, determination string, internal {VALUE}")
    got = {(r["source_id"], r["attribute"]): r for r in verify.orchestrate(planned, seen, own).collect()}
    assert {k: r["status"] for k, r in got.items()} == {("A", "party.owner"): "PARTIAL_MATCH", ("A", "project.name"): "PARTIAL_MATCH", ("M", "party.owner"): "PENDING_MANUAL", ("S", "*"): "NOT_APPLICABLE", ("D", "party.owner"): "SOURCE_UNAVAILABLE"}
    summary = verify.results_summary(verify.orchestrate(planned, seen, own), "case_id").first()
    assert (summary["answered"], summary["adverse"]) == (2, 0)


def test_observed_status_order(spark):
    rows = [("n", False, None, "MATCH", False), ("f", True, None, "MATCH", False), ("i", True, "x", None, False), ("s", True, "x", "MATCH", True), ("m", True, "x", "MATCH", False)]
    frame = spark.createDataFrame(rows, "k string, found boolean, ext string, internal string, stale boolean")
    got = {r["k"]: r["s"] for r in frame.select("k", verify.observed_status(F.lit("MATCH"), F.col("found"), F.col("ext"), F.col("internal"), F.col("stale")).alias("s")).collect()}
    assert got == {"n": "NOT_FOUND_IN_SOURCE", "f": "NOT_APPLICABLE", "i": "NOT_APPLICABLE", "s": "STALE", "m": "MATCH"}


def presence(spark, *results):
    tables = {"cases": spark.createDataFrame([("c",)], "case_id string"), "verification": spark.createDataFrame([("c", *r) for r in results], "case_id string, source_id string, attribute string, tier string, status string, external_value string")}
    ask = lambda name, **p: rules.builder(name)(tables, {"attribute": "a", **p}).first()["determination"]
    return ask("external_record_presence", presence_means="adverse"), ask("external_agreement")


def test_silence_is_never_a_failure(spark):
    assert presence(spark) == ("NOT_DETERMINABLE", "NOT_DETERMINABLE")
    assert presence(spark, ("S", "a", "T2", "SOURCE_UNAVAILABLE", None), ("S", "a", "T4", "PENDING_MANUAL", None)) == ("NOT_DETERMINABLE", "NOT_DETERMINABLE")
    assert presence(spark, ("S", "*", "T2", "NOT_APPLICABLE", None)) == ("NOT_APPLICABLE", "NOT_APPLICABLE")
    assert presence(spark, ("S", "a", "T2", "NOT_APPLICABLE", "a charge")) == ("MISMATCH", "NOT_DETERMINABLE")
    assert presence(spark, ("S", "a", "T2", "NOT_FOUND_IN_SOURCE", None)) == ("MATCH", "MISSING")
    assert presence(spark, ("S", "a", "T6", "MATCH", "x")) == ("MISMATCH", "NOT_DETERMINABLE")
    assert presence(spark, ("S", "a", "T2", "MATCH", "x"), ("S", "a", "T2", "MISMATCH", "y"))[1] == "MISMATCH"


def test_metrics_on_nothing_are_null(spark):
    empty = spark.createDataFrame([], "field string, outcome string")
    got = evaluate.scored(empty.agg(*evaluate.tally())).first()
    assert got["precision"] is None and got["f1"] is None
    cells = spark.createDataFrame([], "expected string, predicted string, n long")
    assert evaluate.confusion_scores(cells).first()["accuracy_on_decided"] is None


def test_truth(spark):
    expected, actual = "struct<text:string,paise:long,date_value:date,sq_m:decimal(28,6),basis:string>", "struct<raw:string,cmp_key:string,paise:long,date_value:date,sq_m:decimal(28,6),basis:string>"
    e = lambda text=None, paise=None, day=None, sq=None, basis=None: (text, paise, day, sq, basis)
    a = lambda raw=None, key=None, paise=None, day=None, sq=None, basis=None: (raw, key, paise, day, sq, basis)
    rows = [
        ("consideration", "money", e(paise=100), a(paise=100), "CORRECT"),
        ("consideration", "money", e(), a(paise=100), "NOT_EVALUATED"),
        ("execution_date", "date", e(day=date(2024, 1, 1)), a(day=date(2024, 1, 2)), "WRONG"),
        ("area", "area", e(sq=Decimal(100), basis="carpet"), a(sq=Decimal(101), basis="built_up"), "NEAR"),
        ("seller", "text", e("Ramesh Patil"), a("R. Patil", "r. patil"), "CORRECT"),
        ("registration_number", "text", e("BDR-4/1"), a("BDR 4 1", "bdr41"), "NEAR"),
        ("cts_number", "parcel", e("12 / 5a"), a("12/5A"), "CORRECT"),
    ]
    frame = spark.createDataFrame(rows, f"field string, kind string, e {expected}, a {actual}, want string")
    got = frame.select("want", evaluate.compare_to_truth(F.col("field"), F.col("kind"), F.col("e"), F.col("a")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_integrity(spark):
    a = spark.createDataFrame([("x", "p"), ("x", "q"), (None, "r")], "id string, ref string")
    problems = integrity.report(integrity.duplicate_ids(a, "id", "a"), integrity.dangling(a, "ref", spark.createDataFrame([("p",)], "id string"), "id", "a"), integrity.difference(a.select("ref"), spark.createDataFrame([("p",), ("z",)], "ref string"), "a", "b"))
    assert problems.count() == 2 + 2 + 3
    assert integrity.totals(problems).first()["exit_code"] == 2
    ready = integrity.rule_ready(spark.createDataFrame([("r1", "i1", "RULE_READY"), ("r2", "i2", "REQUIRES_LEGAL_REVIEW")], "id string, source string, status string"), spark.createDataFrame([("i1", "UNVERIFIED")], "id string, verification_status string"))
    assert {(r["subject"], r["level"]) for r in ready.collect()} == {("r1", "error"), ("r2", "warning")}


def test_feedback(spark):
    log = spark.createDataFrame([("d", "area", "accept", "HIGH", None, 1), ("d", "area", "correct", "HIGH", "1200 sq ft", 2), ("d", "price", "correct", "LOW", "nonsense", 1)], "document_id string, field string, action string, original_confidence string, corrected_value string, at int")
    last = feedback.latest_feedback(log)
    assert {r["original_confidence"]: r["correction_rate"] for r in feedback.calibration(last).collect()} == {"HIGH": 1.0, "LOW": 1.0}
    fields = spark.createDataFrame([("d", "area", "area", "100", "carpet", "LOW"), ("d", "price", "money", "5", None, "LOW")], "document_id string, field string, kind string, cmp_key string, basis string, confidence string")
    got = {r["field"]: r for r in feedback.overlaid(fields, last).collect()}
    assert (got["area"]["cmp_key"], got["area"]["confidence"], got["area"]["provenance"]) == ("111.483648", "HIGH", "human")
    assert (got["price"]["cmp_key"], got["price"]["provenance"]) == ("5", "document")
    every = "document_id string, field string, kind string, cmp_key string, display string, paise long, sq_m double, basis string, date_value date, note string, confidence string"
    fields = spark.createDataFrame([("d", "price", "money", "5", "Rs. 5", 5, None, None, None, None, "LOW"), ("d", "day", "date", "2020-01-01", "1/1/2020", None, None, None, date(2020, 1, 1), None, "LOW")], every)
    fixes = spark.createDataFrame([("d", "price", "correct", "Rs. 12,00,000"), ("d", "day", "correct", "14/03/2024")], "document_id string, field string, action string, corrected_value string")
    got = {r["field"]: r for r in feedback.overlaid(fields, fixes).collect()}
    assert (got["price"]["cmp_key"], got["price"]["paise"], got["price"]["display"], got["price"]["note"]) == ("120000000", 120000000, "Rs. 12,00,000", "corrected from Rs. 5")
    assert (got["day"]["cmp_key"], got["day"]["date_value"], got["day"]["paise"]) == ("2024-03-14", date(2024, 3, 14), None)
    checks = spark.range(1).select(*(feedback.box_check(F.lit(a), F.lit(b)).alias(f"c{i}") for i, (a, b) in enumerate((("deed", "deed"), ("deed", "unknown"), ("deed", "tax"), ("other", "tax"))))).first()
    assert list(checks) == ["OK", "ATTENTION", "BLOCKED", "OK"]
    view = feedback.regulatory_view(spark.createDataFrame([("r", "i", "RULE_READY")], "id string, source string, status string"), spark.createDataFrame([("i", "t", "VERIFIED")], "id string, title string, verification_status string"))
    assert view.first()["blocked_because"] is None


def test_unknown_types_have_no_confidence(spark):
    for text in ("", "lorem ipsum", "DEED OF SALE and AGREEMENT FOR SALE"):
        got = classified(spark, text)
        assert (got["doc_type"], got["confidence"], got["needs_human"]) == ("unknown", "INSUFFICIENT", True)
    assert spark.range(1).select(classify.confidence_value(F.lit("INSUFFICIENT"))).first()[0] == 0.0


def test_a_partial_match_before_a_merge_stays_for_review(spark):
    names = ["Ramesh Kumar Patil", "Rajesh Patil", "R. Patil"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string").select("a", "b", match_names(F.col("a"), F.col("b")).alias("m")).collect()
    met = {(r["a"], r["b"]): (r["m"]["determination"], r["m"]["score"]) for r in pairs}
    claims = spark.createDataFrame([("c", "party.owner", i, n, f"k{i}") for i, n in enumerate(names)], "case_id string, attribute string, ord int, display string, claim_id string")
    got = assemble.merge_parties(claims).collect()
    parties, kept = [], []
    for name in names:  # the rule, name by name
        chosen = None
        for variants in parties:
            at = max(range(len(variants)), key=lambda i: (met[name, variants[i]][1], -i))
            what, score = met[name, variants[at]]
            if what == "MATCH" and score >= assemble.MERGE_AT:
                chosen = variants
                break
            if what == "PARTIAL_MATCH":
                kept.append((name, variants[at]))
        if chosen is None:
            parties.append([name])
        elif name not in chosen:
            chosen.append(name)
    assert [r["variants"] for r in sorted(got, key=lambda r: r["party_no"])] == parties
    assert [(k["left"], k["right"]) for k in got[0]["kept_separate"]] == kept == [(n, names[0]) for n in names[1:]]
    assert assemble.distinct_parties(assemble.merge_parties(claims)).first()["needs_identity_review"]


def test_execution_date_is_the_date_itself(spark):
    page = "This deed is executed at Pune on this 14th day of\nMarch 2024 between the parties named here, of whom each has signed below; the second copy was made on 3/4/2021."
    spans = finders.finder_spans(spark.createDataFrame([("c", "d", 1, page)], "case_id string, document_id string, page int, text string"), ("execution_date",))
    rows = finders.valued(spans).orderBy("start").collect()
    assert [(r["raw"], page[r["start"] : r["end"]]) for r in rows] == [("14th day of\nMarch 2024",) * 2, ("3/4/2021",) * 2]
    assert [str(r["date_value"]) for r in rows] == ["2024-03-14", "2021-04-03"]


def test_values_are_grounded_on_other_pages(spark):
    pages = spark.createDataFrame([("c", "d", 1, "nothing here"), ("c", "d", 2, "the price is Rs.  5,000 only"), ("c", "d", 3, "Rs. 5,000"), ("c", "e", 1, "Rs. 5,000")], "case_id string, document_id string, page int, text string")
    values = spark.createDataFrame([("c", "d", 1, "Rs. 5,000"), ("c", "d", 3, "Rs. 5,000"), ("c", "d", 2, "Rs. 7"), ("c", "d", None, "nothing")], "case_id string, document_id string, page int, raw string")
    got = {(r["page"], r["raw"]): (r["tier"], r["found_page"], r["start"], r["end"]) for r in extract.ground_anywhere(values, pages).collect()}
    assert got == {(1, "Rs. 5,000"): ("collapsed", 2, 13, 23), (3, "Rs. 5,000"): ("exact", 3, 0, 9), (2, "Rs. 7"): (None, None, None, None), (None, "nothing"): ("exact", 1, 0, 7)}


def test_dots_inside_a_name_stay(spark):
    got = spark.range(1).select(split_name(F.lit("Mr. R.K.Sharma, Jr. s/o B. Rao")).alias("t")).first()["t"]
    assert got == ["r.k.sharma", "jr"]


def test_truth_of_booleans(spark):
    truth = lambda want, got: evaluate.compare_to_truth(F.lit("f"), F.lit("bool"), F.struct(*(F.lit(x).alias(n) for n, x in (("text", want), ("paise", None), ("date_value", None), ("sq_m", None), ("basis", None)))), F.struct(F.lit("x").alias("raw"), F.lit(got).alias("cmp_key"), F.lit(None).alias("paise"), F.lit(None).alias("date_value"), F.lit(None).alias("sq_m"), F.lit(None).alias("basis")))
    row = spark.range(1).select(truth("Yes", "true").alias("a"), truth("no", "true").alias("b"), truth("0", "false").alias("c")).first()
    assert list(row) == ["CORRECT", "WRONG", "CORRECT"]


def test_word_errors_of_many_tokens(spark):
    a = [f"w{i}" for i in range(45_000)]
    b = a[:44_990] + ["x"] * 10
    # a long vocabulary costs its square: the renaming alone is tested, on the last tokens
    frame = spark.createDataFrame([(a, a[-3:], b[-3:])], "v array<string>, a array<string>, b array<string>")
    row = frame.select(text.encode_tokens(F.col("a"), F.col("v")).alias("x"), F.levenshtein(text.encode_tokens(F.col("a"), F.array_append("v", F.lit("x"))), text.encode_tokens(F.col("b"), F.array_append("v", F.lit("x")))).alias("d")).first()
    assert len(set(row["x"])) == 3 and row["d"] == 3


def test_survey(spark):
    got = spark.createDataFrame([(1.0,), (2.0,), (5.0,), (9.0,), (None,)], "x double").agg(survey.spread(F.col("x")).alias("s")).first()["s"]
    assert (got["n"], got["min"], got["median"], got["p90"], got["max"]) == (4, 1.0, 3.5, 7.8, 9.0)


def test_analysers_fail_by_file(spark):
    def pdf(data):
        if b"broken" in data:
            raise ValueError("cannot parse")
        return [{"page": i + 1, "rotation": 0, "width": 595.0, "height": 842.0, "text_chars": 900, "devanagari": 0, "other_indic": 0, "latin": 800, "dpi": None, "sharpness": None} for i in range(2)]

    files = [("c", "a", bytearray(b"%PDF-1 ok")), ("c", "b", bytearray(b"%PDF-1 broken")), ("c", "p", bytearray(b"\xff\xd8\xff"))]
    got = ingest.analysed(spark.createDataFrame(files, "case_id string, document_id string, content binary"), {"pdf": pdf})
    assert sorted((r["document_id"], r["ok"], r["error"]) for r in got.select("document_id", "ok", F.coalesce("error", F.lit("")).alias("error")).collect()) == [("a", True, ""), ("a", True, ""), ("b", False, "cannot parse"), ("p", False, "no analyser")]
    metrics = ingest.document_metrics(got.where("ok")).first()
    assert (metrics["page_count"], metrics["text_layer"], metrics["needs_ocr"], metrics["distinct_page_sizes"]) == (2, "DIGITAL", False, 1)


def test_views_of_values(spark):
    none = F.lit(None)
    row = spark.range(1).select(
        claims.displayed(F.lit("money"), none.cast("string"), F.lit(1_250_000_000).cast("long"), none.cast("decimal(28,6)"), none.cast("date")).alias("m"),
        claims.lookup_value(F.lit("parcel"), none.cast("string"), F.lit("CTS|12/5A|"), none.cast("long")).alias("p"),
        extract.provenance(F.lit("x" * 100 + "value" + "y" * 100), F.lit(100), F.lit(105)).alias("v"),
        classify.confidence_value(F.lit("HIGH")).alias("c"),
    ).first()
    assert (row["m"], row["p"], row["c"], len(row["v"]["snippet"])) == ("Rs. 1,25,00,000", "12/5A", 0.9, 125)
    assert len(classify.known_types()) == 9 and len(classify.signals_for("sale_deed")) == 5


def test_case_views(spark):
    planned = spark.createDataFrame([("c", "S", "MANUAL", "blocked")], "case_id string, source_id string, execution string, reason string")
    results = spark.createDataFrame([("c", "S", "PENDING_MANUAL")], "case_id string, source_id string, status string")
    assert feedback.verification_view(planned, results).first()["statuses"] == ["PENDING_MANUAL"]
    metrics = spark.createDataFrame([("findings.spurious", 0.0)], "metric string, value double")
    assert feedback.evaluation_view(metrics, evaluate.check_gates(metrics, evaluate.gate_table(spark))).first()["passed"] is True


def test_each_hit_with_its_text(spark):
    pages = spark.createDataFrame([("d", 1, "vendor vendee vendor"), ("d", 2, "Vendor"), ("e", 1, None)], "document_id string, page int, text string")
    got = classify.hit_evidence(pages, (("party", r"\b(vendor|vendee)\b", "sale_deed", 3000, False),)).orderBy("page", "place").collect()
    assert [(r["page"], r["place"], r["matched_text"], r["contribution"]) for r in got] == [(1, 1, "vendor", 3000), (1, 2, "vendee", 3000)]


def test_every_note_of_an_amount_stays(spark):
    text = "Consideration: Rs. 12,50,0000/- (Rupees One Crore only)"
    spans = finders.finder_spans(spark.createDataFrame([("c", "d", 1, text)], "case_id string, document_id string, page int, text string"))
    got = finders.valued(spans).where("finder = 'consideration'").first()
    assert got["notes"] == ["figures and words differ", "irregular grouping"] and got["note"] == "figures and words differ"


def test_messages_name_what_a_check_tells(spark):
    rule = {"rule_id": "R", "title": "T", "category": "c", "severity": "HIGH", "determinacy": "DETERMINISTIC", "check": "documents_present", "params": {"document_types": ["a", "b"]}, "message": "{missing} of {expected_count}: {detail}"}
    other = rule | {"rule_id": "S", "message": "no {such} name"}
    cases = spark.createDataFrame([("c", ["a"]), ("d", ["a", "b"])], "case_id string, present array<string>")
    for column in ("lender_type", "product", "state", "transaction_type", "security_type"):
        cases = cases.withColumn(column, F.lit(None).cast("string"))
    cases = cases.withColumn("regulatory_as_of", F.lit("2024-01-01").cast("date"))
    claims = spark.createDataFrame([], "case_id string, subject_id string, attribute string, claim_id string, ord long, kind string, cmp_key string, sq_m decimal(28,6), basis string")
    got = {(r["case_id"], r["rule_id"]): (r["determination"], r["message"]) for r in rules.evaluate({"cases": cases, "claims": claims}, [rule, other]).collect()}
    assert got == {("c", "R"): ("MISSING", "b of 2: b"), ("c", "S"): ("MISSING", "b"), ("d", "R"): ("MATCH", ""), ("d", "S"): ("MATCH", "")}


def test_adapters_fail_by_source(spark):
    planned = spark.createDataFrame(
        [("c", "A", "T2", 30, "AUTOMATED", "k", "v", ["party.owner"], ["k0"]), ("c", "B", "T2", 30, "AUTOMATED", "k", "v", ["party.owner"], []), ("c", "M", "T4", 30, "MANUAL", "k", "v", ["party.owner"], [])],
        "case_id string, source_id string, tier string, freshness_days int, execution string, lookup_key string, lookup_value string, attributes array<string>, ambiguous array<string>",
    )
    owner = {"kind": "text", "cmp_key": "r. patil", "raw": "R. Patil", "sq_m": None, "basis": "unspecified"}
    seen = verify.observed(planned, {"A": verify.static_adapter({"v": {"party.owner": {"external": owner, "retrieved_at": datetime(2024, 1, 1)}}})})
    got = {r["source_id"]: r for r in seen.collect()}
    assert got["A"]["record_found"] and got["A"]["external"]["raw"] == "R. Patil" and "NotImplementedError" in got["B"]["error"] and "M" not in got
    own = spark.createDataFrame([("c", "party.owner", "MATCH", ("text", "ramesh patil", "Ramesh Patil", None, "unspecified"))], f"case_id string, attribute string, determination string, internal {VALUE}")
    results = verify.orchestrate(planned, seen, own)
    assert {r["source_id"]: r["status"] for r in results.collect()} == {"A": "MATCH", "B": "SOURCE_UNAVAILABLE", "M": "PENDING_MANUAL"}
    assert [(r["source_id"], r["note"]) for r in verify.key_notes(planned).collect()] == [("A", "disputed: k0; asked by k")]
    back = verify.written_back(spark.createDataFrame([("c",), ("x",)], "case_id string"), results).orderBy("case_id").collect()
    assert (back[0]["verification"]["total"], back[1]["verification"]["total"]) == (3, 0)


def test_task_board(spark):
    tasks = spark.createDataFrame([("a", 2, 1), ("b", 1, 2), ("c", 1, 1)], "task_id string, priority int, created_at int")
    done = verify.task_events(tasks.where("task_id = 'c'"), "UNOBTAINABLE", F.lit(5), F.lit("op"), note=F.lit("site down")).withColumn("ord", F.lit(1))
    assert [(r["task_id"], r["state"]) for r in verify.task_board(tasks, done).collect()] == [("b", "OPEN"), ("a", "OPEN")]
    assert verify.task_board(tasks, done, open_only=False).count() == 3


def test_claims_stay_in_their_set(spark):
    held = spark.createDataFrame([("s", "a", "1")], "subject_id string, attribute string, claim_id string")
    assert claims.append(held, held, "s", "a").count() == 2
    with pytest.raises(Exception, match="another subject_id"):
        claims.append(held, held, "t").collect()


def test_engines(spark):
    assert pages.default_engine(None)[0] is None
    assert pages.default_engine(lambda: 1 / 0) == (None, "ZeroDivisionError: division by zero")
    block = {"text": "x", "x0": 200.0, "y0": 0.0, "x1": 400.0, "y1": 200.0, "confidence": 0.5}
    images = spark.createDataFrame([("s", b"1")], "sha256 string, content binary")
    got = pages.recognised_images(images, lambda data: [block]).first()
    assert (got["page"], got["source"]) == (1, "ocr") and abs(got["blocks"][0]["x0"] - 72.0) < 1e-9
    assert pages.recognised_images(images, None).first()["source"] == "empty"


def test_areas_without_size_stay_apart(spark):
    rows = [claim(1, "100", kind="area", sq_m=100), claim(2, "none", kind="area"), claim(3, "100", kind="area", sq_m=100), claim(4, "none", kind="area"), claim(5, "101", kind="area", sq_m=101)]
    got = claims.clusters(spark.createDataFrame(rows, CLAIM)).orderBy("first_ord").collect()
    assert [(r["leader"], r["first_ord"], r["n"]) for r in got] == [("100", 1, 3), ("none", 2, 1), ("none", 4, 1)]
