"""Single functions and helpers over the tables, value by value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import dates, names, text
from claimloom.operators import assemble, claims, classify, feedback, verify
from claimloom.plans.documents import SIGNALS, document_pages
from claimloom.plans.registry import query, table
from claimloom.sources import stores


def _hits_sql() -> str:
    parts = []
    for name, pattern, kind, milli, title in SIGNALS:
        held = "CASE WHEN page = 1 THEN left(text, 1200) END" if title else "text"
        parts.append(f"SELECT document_id, page, '{name}' AS signal, '{kind}' AS doc_type, {milli} AS weight, regexp_extract_all({held}, '(?i){pattern}') AS ms FROM p")
    return f"""WITH p AS (SELECT doc_id AS document_id, unnest(generate_series(1, len(ls))) AS page, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
h AS (SELECT * EXCLUDE ms, unnest(ms) AS m, unnest(generate_series(1, len(ms))) AS place FROM ({' UNION ALL '.join(parts)}) WHERE len(ms) > 0),
v AS (SELECT *, weight * CASE page WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 3 END // 20 AS points FROM h),
c AS (SELECT *, least(points, greatest(0, weight * 2 - coalesce(sum(points) OVER (PARTITION BY document_id, signal ORDER BY page, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS contribution FROM v)
SELECT document_id, page, signal, doc_type, place, left(m, 120) AS matched_text, contribution FROM c WHERE contribution > 0"""


@query(_hits_sql())
def classify_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Every hit that counts for a document's type, with the text that matched and what it adds."""
    out = classify.hit_evidence(document_pages(spark, folder), SIGNALS)
    return out.select("document_id", F.col("page").cast("long").alias("page"), "signal", "doc_type", F.col("place").cast("long").alias("place"), "matched_text", "contribution")


@query("""SELECT user_id AS task_id, user_id % 7 AS priority, coalesce(s, 'OPEN') AS state FROM (SELECT user_id, min(ts) AS created_at,
 arg_max(CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'UNOBTAINABLE' WHEN 'view' THEN 'IN_PROGRESS' WHEN 'click' THEN 'CANCELLED' ELSE 'OPEN' END, (ts, event_id)) AS s FROM events GROUP BY 1) WHERE s IN ('OPEN', 'IN_PROGRESS')""")
def task_board(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks that someone must still act on, by the last state in an append-only log."""
    rows = table(spark, folder, "events")
    kind = F.col("event_type")
    state = F.when(kind == "purchase", "COMPLETED").when(kind == "error", "UNOBTAINABLE").when(kind == "view", "IN_PROGRESS").when(kind == "click", "CANCELLED").otherwise("OPEN")
    log = rows.select(F.col("user_id").alias("task_id"), state.alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("ord"))
    tasks = rows.groupBy(F.col("user_id").alias("task_id")).agg(F.min("ts").alias("created_at")).withColumn("priority", F.col("task_id") % 7)
    return verify.task_board(tasks, log).select("task_id", "priority", "state")


@query("SELECT c_custkey, c_name AS plain, lower(replace(c_name, '#', ' ')) AS tokens FROM customer")
def name_plain(spark: SparkSession, folder: str) -> DataFrame:
    """Names without honorific and stray punctuation, and their tokens."""
    written = F.concat(F.element_at(F.array(F.lit("Shri "), F.lit("  MRS.  "), F.lit(""), F.lit("Late ")), (F.col("c_custkey") % 4 + 1).cast("int")), F.col("c_name"), F.lit(" , ;"))
    kin = F.concat(written, F.lit(" S / O Someone Else"))
    return table(spark, folder, "customer").select("c_custkey", names.normalise_name(written).alias("plain"), F.array_join(names.split_name(kin), " ").alias("tokens"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 150 >= 100 THEN p_partkey % 150 WHEN p_partkey % 150 > 30 THEN 1900 + p_partkey % 150 ELSE 2000 + p_partkey % 150 END AS year FROM part")
def year_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Years of two digits with their century, others as they are."""
    return table(spark, folder, "part").select("p_partkey", dates.expand_year(F.col("p_partkey") % 150).cast("long").alias("year"))


@query("""SELECT doc_id, length(regexp_replace(text, '[^ऀ-ॿ]', '', 'g')) AS devanagari, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin,
 regexp_replace(lower(text), '[^a-z0-9]', '', 'g') = regexp_replace(lower(left(text, 80)), '[^a-z0-9]', '', 'g') AS near FROM documents""")
def script_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Letters by script, and whether a text's first characters hold all its letters and digits."""
    letters = text.script_counts(F.col("text"))
    near = text.alnum(F.col("text")) == text.alnum(F.left("text", F.lit(80)))
    return table(spark, folder, "documents").select("doc_id", letters["devanagari"].cast("long").alias("devanagari"), letters["latin"].cast("long").alias("latin"), near.alias("near"))


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN round(least(greatest((floor(value)::BIGINT - 50) / 200.0, 0), 1)::DOUBLE, 4) END AS confidence,
 CASE WHEN event_type <> 'view' THEN 'user ' || user_id || ': ' || event_type || '.' END AS message FROM events""")
def confidence_and_message(spark: SparkSession, folder: str) -> DataFrame:
    """Confidences clamped from text, null for what is no number; templates, null where a name has no value."""
    raw = F.when(F.col("event_type") != "error", ((F.floor("value") - 50) / 200.0).cast("string")).otherwise("n/a")
    known = F.map_filter(F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("what"), F.col("event_type")), lambda k, v: v != "view")
    return table(spark, folder, "events").select("event_id", text.confidence_value(raw).alias("confidence"), text.rendered("user {user}: {what}.", known).alias("message"))


@query("""SELECT l_orderkey, l_linenumber, least(a, b, c, d) / 2.0 AS x0, greatest(a, b, c, d) / 2.0 AS x1, (greatest(a, b, c, d) - least(a, b, c, d)) / 2.0 AS width
FROM (SELECT l_orderkey, l_linenumber, (l_orderkey % 17)::DOUBLE AS a, (l_partkey % 31)::DOUBLE AS b, l_linenumber::DOUBLE AS c, (l_suppkey % 13)::DOUBLE AS d FROM lineitem)""")
def quad_geometry(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes around quadrilaterals, scaled, and their widths."""
    points = [(F.col("l_orderkey") % 17), (F.col("l_partkey") % 31), F.col("l_linenumber"), (F.col("l_suppkey") % 13)]
    quad = F.array(*(F.struct(p.cast("double").alias("x"), p.cast("double").alias("y")) for p in points))
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", text.quad_box(quad, 2.0).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", "b.x0", "b.x1", text.box_size(F.col("b"))["width"].alias("width"))


@query("""SELECT l_orderkey AS case_id, count(*) AS n_documents, count(*) FILTER (l_linestatus = 'F') AS n_originals, count(*) FILTER (l_linenumber <> 3) AS n_usable, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS present,
 coalesce(array_to_string(list_sort(list(DISTINCT l_returnflag) FILTER (l_linestatus = 'F')), ','), '') AS originals FROM lineitem GROUP BY 1""")
def custody_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """A case's documents: how many, in original, usable, and of which types."""
    quality = F.when(F.col("l_linenumber") == 3, "REJECTED")
    held = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("document_type"), F.when(F.col("l_linestatus") == "F", "original_held").otherwise("copy").alias("custody"), quality.alias("quality"))
    return claims.custody_inventory(held).withColumns({"present": F.array_join("present", ","), "originals": F.array_join("originals", ",")})


@query("SELECT o_orderkey, list_has_any([o_orderkey % 5, o_custkey % 4], [o_custkey % 6, 1]) AS shared FROM orders")
def parcel_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Whether two properties share a parcel identifier."""
    parcel = lambda n: claims.parcel_key(F.lit("cts"), F.concat(F.lit(" "), n.cast("string"), F.lit("/ .")), F.lit("pune"))
    left, right = F.array(parcel(F.col("o_orderkey") % 5), parcel(F.col("o_custkey") % 4)), F.array(parcel(F.col("o_custkey") % 6), parcel(F.lit(1)))
    return table(spark, folder, "orders").select("o_orderkey", claims.share_identifier(left, right).alias("shared"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN (o_custkey * 100)::VARCHAR WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END WHEN 3 THEN lower(o_orderstatus) END AS cmp_key,
 CASE WHEN o_orderkey % 5 = 0 THEN (o_custkey * 100)::VARCHAR END AS paise, CASE WHEN o_orderkey % 5 = 4 THEN 'unreadable as date' END AS error FROM orders""")
def correction_values(spark: SparkSession, folder: str) -> DataFrame:
    """Corrections read as their field's kind; what can't be read is refused."""
    at = F.col("o_orderkey") % 5
    kind = F.when(at == 0, "money").when(at.isin(1, 4), "date").when(at == 2, "bool").otherwise("text")
    said = F.when(at == 0, F.col("o_custkey").cast("string")).when(at == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(at == 2, F.when(F.col("o_custkey") % 2 == 0, " Yes").otherwise("NO")).when(at == 3, F.concat(F.lit(" "), F.col("o_orderstatus"))).otherwise("some day soon")
    rows = table(spark, folder, "orders").select("o_orderkey", feedback.parse_correction(kind, said, F.lit("carpet")).alias("c"))
    return rows.select("o_orderkey", "c.cmp_key", F.col("c.paise").cast("string").alias("paise"), "c.error")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'OK' WHEN 1 THEN CASE WHEN p_brand = 'Brand#1' THEN 'OK' ELSE 'BLOCKED' END WHEN 2 THEN 'ATTENTION' ELSE 'BLOCKED' END AS verdict FROM part""")
def box_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a file is what its box expects, may be, or must be confirmed."""
    at = F.col("p_partkey") % 4
    predicted = F.when(at == 2, "unknown").otherwise(F.col("p_brand"))
    expected = F.when(at == 0, "other").when(at == 1, "Brand#1").otherwise("Brand#none")
    return table(spark, folder, "part").select("p_partkey", feedback.box_check(expected, predicted).alias("verdict"))


@query("""SELECT doc_id, count(*) AS n_pages, sum(length(line))::BIGINT AS text_chars, sum(length(line)) > 1000 AS text_layer, count(*) FILTER (page BETWEEN 2 AND 3) AS dumped
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS page FROM documents) GROUP BY 1""")
def corpus_identify(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a text corpus: pages, characters, whether they have a text layer, and how many of pages 2 and 3 a dump shows."""
    pages = document_pages(spark, folder).withColumnRenamed("document_id", "doc")
    shown = stores.dumped(pages, 2, 3).groupBy("doc").agg(F.count("*").alias("dumped"))
    out = stores.identified(pages).join(shown, "doc", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n_pages").cast("long").alias("n_pages"), "text_chars", "text_layer", F.coalesce("dumped", F.lit(0)).alias("dumped"))


@query("""SELECT p_brand AS case_id, count(*) AS n_claims, count(*) FILTER (p_size % 2 = 0) AS n_property_only, count(*) FILTER (p_size % 2 = 1) * 2 AS n_people FROM part GROUP BY 1""")
def party_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """People's claims belong to the property and to a party; others to the property alone."""
    rows = table(spark, folder, "part")
    attribute = F.when(F.col("p_size") % 2 == 1, "party.owner").otherwise("property.area")
    told = rows.select(F.col("p_brand").alias("case_id"), F.lit("PROP").alias("subject_id"), attribute.alias("attribute"), F.col("p_partkey").cast("string").alias("claim_id"), F.lit(1).alias("one"))
    # one party for each owner's claim, as merging would give for names without likeness
    merged = assemble.party_claims(told).select("case_id", "attribute", F.col("claim_id").cast("int").alias("party_no"), F.array("claim_id").alias("claim_ids"))
    both = assemble.with_party_claims(told, merged)
    is_person = F.col("attribute") == "party.owner"
    by_case = both.groupBy("case_id").agg(F.count_if(F.col("subject_id") == "PROP").alias("n_claims"), F.count_if(~is_person).alias("n_property_only"), F.count_if(is_person).alias("n_people"))
    return by_case


@query("""SELECT * FROM (VALUES
 ('bundle_sale_deed', 'transaction.consideration', '1250000000'), ('bundle_agreement', 'transaction.consideration', '1250000000'),
 ('bundle_sale_deed', 'date', '2024-03-14'), ('bundle_agreement', 'date', '2024-01-02'),
 ('bundle_sale_deed', 'person', 'shri ramesh patil'), ('bundle_sale_deed', 'person', 'smt. anita desai')) t(document_id, what, cmp_key)""")
def bundle_values(spark: SparkSession, folder: str) -> DataFrame:
    """What the bundle's deeds say was paid, when and by whom. An honorific that follows a recital word stays with its name."""
    from claimloom.plans.bundle import bundle_cases, bundle_pages, process

    pages = bundle_pages(spark)
    rows = process(pages, bundle_cases(spark))["fields"].where("tier is not null")
    what = F.when(F.col("attribute") == "transaction.consideration", F.col("attribute")).when(F.col("kind") == "date", "date").when(F.col("attribute").isin("party.seller", "party.buyer") & (F.col("document_id") == "bundle_sale_deed"), "person")
    return rows.select("document_id", what.alias("what"), "cmp_key").where("what is not null").distinct()
