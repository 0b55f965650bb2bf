"""Classification, ingest, quality, pages and grounding, over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions.binding import let
from claimloom.functions.text import collapsed, ground_tier, script_counts
from claimloom.operators import classify, ingest, integrity, pages, survey
from claimloom.plans.registry import query, table
from claimloom.session import spread

#: Signals that occur in the tables: the same machinery, other phrases.
SIGNALS = (
    ("license_line", r"licensed under", "license", 9000, False),
    ("license_title", r"license", "license", 4000, True),
    ("mail", r"[a-z0-9.]+@[a-z0-9]+\.example\.com", "contact", 8000, False),
    ("address", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "network", 8000, False),
    ("token", r"token = ", "credential", 10000, False),
    ("table_row", r" \| ", "table", 500, False),
    ("shouting", r"!! ", "junk", 1000, False),
)


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents as pages."""
    split = spread(table(spark, folder, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return split.withColumn("page", F.col("page") + 1)


def _hit_sql() -> str:
    parts = []
    for i, (name, pattern, kind, milli, title) in enumerate(SIGNALS):
        text = "CASE WHEN page = 1 THEN left(text, 1200) END" if title else "text"
        parts.append(f"SELECT document_id, page, '{name}' AS signal, {i} AS ord, '{kind}' AS doc_type, {milli} AS weight, coalesce(len(regexp_extract_all({text}, '(?i){pattern}')), 0) AS hits FROM p")
    return f"""p AS (SELECT doc_id AS document_id, unnest(generate_series(1, len(ls))) AS page, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
h AS (SELECT *, hits * weight * CASE page WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 3 END // 20 AS points FROM ({' UNION ALL '.join(parts)}) WHERE hits > 0)"""


@query(f"""WITH {_hit_sql()}, s AS (SELECT document_id, signal, doc_type, ord, least(max(weight) * 2, sum(points)::BIGINT) AS points FROM h GROUP BY ALL),
t AS (SELECT document_id, doc_type, sum(points)::BIGINT AS points, min(ord) AS ord FROM s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY points DESC, ord) AS rn FROM t),
d AS (SELECT doc_id AS document_id, bool_or(length(trim(text, ' ')) > 0) AS has_text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents) GROUP BY 1),
w AS (SELECT d.document_id, has_text, coalesce(a.points, 0) AS best, coalesce(b.points, 0) AS second, a.doc_type AS first FROM d LEFT JOIN r a ON a.document_id = d.document_id AND a.rn = 1 LEFT JOIN r b ON b.document_id = d.document_id AND b.rn = 2),
x AS (SELECT *, CASE WHEN NOT has_text THEN 'NO_TEXT' WHEN best < 8000 THEN 'WEAK' WHEN second > 0 AND best < second * 1.5 THEN 'AMBIGUOUS' END AS reason FROM w)
SELECT document_id, CASE WHEN reason IS NULL THEN first ELSE 'unknown' END AS doc_type, reason, CASE WHEN reason IS NOT NULL THEN 'INSUFFICIENT' WHEN best >= 16000 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
 best, second AS runner_up, reason IS NOT NULL AS needs_human FROM x""")
def classify_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by weighted phrases, or unknown with a reason."""
    return classify.classify(document_pages(spark, folder), SIGNALS)


@query(f"""WITH {_hit_sql()} SELECT document_id, page, signal, hits, least(points, greatest(0, weight * 2 - coalesce(sum(points) OVER (PARTITION BY document_id, signal ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS contribution FROM h""")
def classify_evidence_running_cap(spark: SparkSession, folder: str) -> DataFrame:
    """What each page's hits add until their signal's cap is reached."""
    hits = classify.signal_hits(document_pages(spark, folder), SIGNALS)
    return classify.evidence(hits).select("document_id", F.col("page").cast("long").alias("page"), "signal", "hits", F.col("contribution").cast("long").alias("contribution"))


_METRICS = """
WITH p AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT doc_id, any_value(source) AS source, count(*) AS page_count, median(length(line))::DOUBLE AS median_chars,
 count(*) FILTER (length(line) % 4 = 1) AS rotated_pages, count(DISTINCT length(line) // 1000) AS distinct_page_sizes,
 min(CASE WHEN length(line) * 2.0 > 10 AND length(line) * 2.0 < 2400 THEN length(line) * 2.0 END) AS min_dpi, median(length(line) % 100)::DOUBLE AS median_sharpness FROM p GROUP BY 1),
l AS (SELECT *, CASE WHEN median_chars >= 200 THEN 'DIGITAL' WHEN median_chars <= 20 THEN 'SCANNED' ELSE 'MIXED' END AS text_layer FROM m),
q AS (SELECT *, list_filter([
 CASE WHEN text_layer <> 'DIGITAL' AND min_dpi < 100 THEN 'VERY_LOW_RESOLUTION' WHEN text_layer <> 'DIGITAL' AND min_dpi < 200 THEN 'LOW_RESOLUTION' END,
 CASE WHEN text_layer <> 'DIGITAL' AND median_sharpness IS NULL THEN 'UNMEASURED_SHARPNESS' WHEN text_layer <> 'DIGITAL' AND median_sharpness < 60 THEN 'BLURRY' END,
 CASE WHEN text_layer = 'MIXED' THEN 'PARTIAL_TEXT_LAYER' WHEN text_layer = 'SCANNED' AND min_dpi IS NULL THEN 'NO_TEXT_AND_LOW_RESOLUTION' END,
 CASE WHEN rotated_pages > 0 THEN 'ROTATED_PAGES' END, CASE WHEN distinct_page_sizes > 1 THEN 'MIXED_PAGE_SIZES' END], lambda x: x IS NOT NULL) AS notes FROM l),
v AS (SELECT *, CASE WHEN page_count > 800 THEN 'REJECTED' WHEN len(notes) > 0 THEN 'DEGRADED' ELSE 'OK' END AS quality FROM q)
"""


def document_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as pages: their lengths stand in for resolution, rotation and sharpness."""
    lines = table(spark, folder, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    length = F.length("line")
    letters = script_counts(F.col("line"))
    rows = lines.select(
        "doc_id", length.alias("text_chars"), letters["devanagari"].alias("devanagari"), letters["other_indic"].alias("other_indic"), letters["latin"].alias("latin"),
        F.when(length % 4 == 1, 90).otherwise(0).alias("rotation"), F.floor(length / 1000).cast("double").alias("width"), F.lit(1.0).alias("height"), (length * 2.0).alias("dpi"), (length % 100).cast("double").alias("sharpness"),
    )
    return ingest.document_metrics(rows, ("doc_id",)).withColumns({"ok": F.lit(True), "encrypted": F.lit(False)})


@query(_METRICS + "SELECT doc_id, page_count, median_chars, text_layer, rotated_pages, distinct_page_sizes, array_to_string(CASE WHEN quality = 'REJECTED' THEN ['TOO_MANY_PAGES'] ELSE notes END, ',') AS notes, quality FROM v")
def quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Structural metrics of documents and the verdict on them."""
    out = ingest.quality_gate(document_metrics(spark, folder))
    return out.select("doc_id", "page_count", "median_chars", "text_layer", "rotated_pages", "distinct_page_sizes", F.array_join("quality_notes", ",").alias("notes"), "quality")


@query(_METRICS + """, s AS (SELECT text_layer, count(*) AS documents, count(*) FILTER (min_dpi < 200) AS under_200_dpi, count(*) FILTER (min_dpi < 150) AS under_150_dpi, count(*) FILTER (rotated_pages > 0) AS rotated,
 count(*) FILTER (distinct_page_sizes > 1) AS mixed_sizes, min(page_count) AS pages_min, max(page_count) AS pages_max, round(quantile_cont(page_count::DOUBLE, 0.5), 2) AS pages_median, round(quantile_cont(page_count::DOUBLE, 0.9), 2) AS pages_p90 FROM v GROUP BY 1)
SELECT * FROM s""")
def corpus_survey(spark: SparkSession, folder: str) -> DataFrame:
    """Distributions and counts by text layer, in one pass."""
    out = survey.survey(document_metrics(spark, folder), "text_layer")
    return out.select("text_layer", "documents", "under_200_dpi", "under_150_dpi", "rotated", "mixed_sizes", F.col("pages.min").cast("long").alias("pages_min"), F.col("pages.max").cast("long").alias("pages_max"), F.col("pages.median").alias("pages_median"), F.col("pages.p90").alias("pages_p90"))


@query("""SELECT CASE WHEN GROUPING(lang) = 0 THEN 'lang' WHEN GROUPING(source) = 0 THEN 'source' ELSE 'has_quality' END AS dimension,
 CASE WHEN GROUPING(lang) = 0 THEN lang WHEN GROUPING(source) = 0 THEN source ELSE has_quality::VARCHAR END AS value, count(*) AS n
FROM (SELECT d.*, l.doc_id IS NOT NULL AS has_quality FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY GROUPING SETS ((lang), (source), (has_quality))""")
def survey_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Several counters over one pass of the corpus: grouping sets."""
    labelled = table(spark, folder, "labels").select(F.col("doc_id").alias("of"))
    rows = table(spark, folder, "documents").select("doc_id", "lang", "source").join(labelled, F.col("doc_id") == F.col("of"), "left").withColumn("has_quality", F.col("of").isNotNull())
    return survey.counted(rows, "lang", "source", "has_quality")


@query("SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 10")
def survey_top_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most frequent producers, here hosts of pages."""
    return survey.top(table(spark, folder, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")), "host")


@query("""SELECT doc_id, sha256(text) AS sha256, CASE WHEN row_number() OVER w > 1 THEN first_value(doc_id) OVER w ELSE -1 END AS duplicate_of FROM documents WINDOW w AS (PARTITION BY source, sha256(text) ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def content_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Same content within a source: the first is kept, later ones point to it."""
    files = table(spark, folder, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    return ingest.duplicates(files, "sha256", "source", "doc_id", "doc_id").select("doc_id", "sha256", F.coalesce("duplicate_of", F.lit(-1)).alias("duplicate_of"))


_PAGE_MAGIC = (("html", "3C21444F43545950452068746D6C"), ("html", "3C68746D6C"))
_PAGE_TOKENS = (("<script", "SCRIPT", True), ("onclick", "SCRIPT", True), ("<iframe", "FRAME", True), ("<style", "STYLE", False), ("<form", "FORM", False), ("<nav", "NAVIGATION", False))


@query("""WITH s AS (SELECT page_id, CASE WHEN starts_with(html, '<!DOCTYPE html') OR starts_with(html, '<html') THEN 'html' END AS file_type,
 list_filter([CASE WHEN contains(html, '<script') OR contains(html, 'onclick') THEN 'SCRIPT' END, CASE WHEN contains(html, '<iframe') THEN 'FRAME' END, CASE WHEN contains(html, '<style') THEN 'STYLE' END,
 CASE WHEN contains(html, '<form') THEN 'FORM' END, CASE WHEN contains(html, '<nav') THEN 'NAVIGATION' END], lambda x: x IS NOT NULL) AS codes FROM pages)
SELECT page_id, file_type, array_to_string(codes, ',') AS codes, CASE WHEN file_type IS NULL OR list_has_any(codes, ['SCRIPT', 'FRAME']) THEN 'BLOCKED' WHEN len(codes) > 0 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict FROM s""")
def safety_scan_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Format by first bytes, then tokens of risky capabilities."""
    content = F.col("html").cast("binary")
    kind, hard, soft = ingest.sniff(content, _PAGE_MAGIC), ingest.token_codes(content, _PAGE_TOKENS, True), ingest.token_codes(content, _PAGE_TOKENS, False)
    verdict = F.when(kind.isNull() | (F.size(hard) > 0), "BLOCKED").when(F.size(soft) > 0, "SUSPICIOUS").otherwise("SAFE")
    return table(spark, folder, "pages").select("page_id", kind.alias("file_type"), F.array_join(F.concat(hard, soft), ",").alias("codes"), verdict.alias("verdict"))


@query("""WITH p AS (SELECT page_id, trim(regexp_replace(html, '<[^>]*>', ' ', 'g'), ' ') AS text FROM pages) SELECT CASE WHEN length(text) >= 20 THEN 'text_layer' ELSE 'ocr' END AS source, count(*) AS n FROM p GROUP BY 1""")
def page_routing(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with usable text, and those for OCR."""
    plain = table(spark, folder, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return pages.source_counts(pages.routed(plain))


@query("""WITH s AS (SELECT conv_id, turn, role, length(text) AS n, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM conversations)
SELECT conv_id, turn, role, char_start, char_start + n AS char_end, char_start <= 200 AND 200 < char_start + n AS holds_200 FROM s""")
def assemble_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as blocks of one text: their spans, and the block at an offset."""
    spans = pages.running_spans(table(spark, folder, "conversations"), ["conv_id"], ["turn"])
    return spans.select("conv_id", "turn", "role", "char_start", "char_end", ((F.col("char_start") <= 200) & (F.lit(200) < F.col("char_end"))).alias("holds_200"))


@query("""SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n_blocks FROM conversations WHERE length(trim(text, ' ')) > 0 GROUP BY 1""")
def assemble_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A conversation's turns, one above the other, as the text of a page."""
    number = lambda v: F.lit(v).cast("double")
    blocks = table(spark, folder, "conversations").select("conv_id", "text", number(0).alias("x0"), F.col("turn").cast("double").alias("y0"), number(1).alias("x1"), F.col("turn").cast("double").alias("y1"), number(None).alias("confidence"))
    return pages.assembled(blocks, "conv_id").select("conv_id", "text", F.size("blocks").cast("long").alias("n_blocks"))


@query("""WITH d AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS flat FROM documents), b AS (SELECT item_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS flat FROM benchmark)
SELECT doc_id, item_id, CASE WHEN contains(d.text, b.text) THEN 'exact' ELSE 'collapsed' END AS tier FROM d, b WHERE contains(d.flat, b.flat)""")
def ground_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """Where benchmark passages stand in documents, as they are or with other white space.

    Candidates meet by the hash of five words: a passage's first five, and each run of five of a document. Only passages that
    meet are looked for, so no document is compared with every passage.
    """
    flat = lambda df: df.withColumn("words", F.split(collapsed(F.col("text")), " "))
    docs = flat(spread(table(spark, folder, "documents").select("doc_id", "text")))
    items = flat(table(spark, folder, "benchmark").select("item_id", F.col("text").alias("passage"), F.col("text")))
    five = lambda h, i: F.xxhash64(*(F.get(h, i + j) for j in range(5)))
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    runs = let(hashed, lambda h: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: five(h, i))))
    keyed = items.where(F.size("words") >= 7).select("item_id", "passage", let(hashed, lambda h: five(h, F.lit(1))).alias("key"))
    met = docs.where(F.size("words") >= 5).select("doc_id", F.explode(runs).alias("key")).join(keyed, "key").select("doc_id", "item_id", "passage").distinct()
    short = items.where(F.size("words") < 7).select("item_id", "passage")
    # few passages are that short; the planner broadcasts them if they are small
    found = docs.select("doc_id", "text").join(met, "doc_id").unionByName(docs.select("doc_id", "text").crossJoin(short))
    return found.withColumn("tier", ground_tier(F.col("text"), F.col("passage"))).where(F.col("tier").isin("exact", "collapsed")).select("doc_id", "item_id", "tier")


@query("""WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'),
m AS (SELECT p.event_id AS anchor, v.event_id AS chosen, CASE WHEN v.ts >= p.ts THEN 0 ELSE 1 END AS side, abs(epoch_us(v.ts) - epoch_us(p.ts)) AS gap FROM p JOIN v USING (user_id)
 WHERE (v.ts >= p.ts AND epoch_us(v.ts) - epoch_us(p.ts) <= 86400000000) OR (v.ts <= p.ts AND epoch_us(p.ts) - epoch_us(v.ts) <= 43200000000))
SELECT anchor, chosen, gap FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY side, gap, chosen) AS rn FROM m) WHERE rn = 1""")
def nearest_anchor(spark: SparkSession, folder: str) -> DataFrame:
    """For each purchase the nearest view within a day after it, else within half a day before."""
    micro = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", micro.alias("at"))
    anchors = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("anchor"), F.col("at").alias("a_at"))
    views = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("chosen"), "at")
    gap = F.col("at") - F.col("a_at")
    # days as equal keys: an anchor meets the views of its own day and the next to it, not all of its user's
    day = 86_400_000_000
    spread = anchors.withColumn("day", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.floor(F.col("a_at") / day) + i)))
    met = spread.join(views.withColumn("day", F.floor(F.col("at") / day)), ["user_id", "day"]).where(((gap >= 0) & (gap <= day)) | ((gap <= 0) & (-gap <= day // 2)))
    best = Window.partitionBy("anchor").orderBy(F.when(gap >= 0, 0).otherwise(1), F.abs(gap), "chosen")
    return met.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("anchor", "chosen", F.abs(gap).alias("gap"))


@query("""WITH x(check_name, level, n) AS (
 SELECT 'orders: duplicate id', 'error', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) UNION ALL
 SELECT 'lineitem: duplicate id', 'error', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)) UNION ALL
 SELECT 'orders: dangling reference', 'error', (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL
 SELECT 'lineitem: dangling reference', 'error', (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL
 SELECT 'in orders, not in lineitem', 'error', (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) UNION ALL
 SELECT 'in lineitem, not in orders', 'error', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) UNION ALL
 SELECT 'negative balance', 'warning', (SELECT count(*) FROM customer WHERE c_acctbal < 0))
SELECT check_name AS "check", level, n FROM x WHERE n > 0""")
def kb_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Duplicate ids, dangling references, both-way differences and an invariant, by count."""
    orders, lineitem, customer = (table(spark, folder, n) for n in ("orders", "lineitem", "customer"))
    keyed = lineitem.withColumn("key", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    problems = integrity.report(
        integrity.duplicate_ids(orders, "o_orderkey", "orders"),
        integrity.duplicate_ids(keyed, "key", "lineitem"),
        integrity.dangling(orders, "o_custkey", customer, "c_custkey", "orders"),
        integrity.dangling(lineitem, "l_orderkey", orders, "o_orderkey", "lineitem"),
        integrity.difference(orders.select("o_orderkey"), lineitem.select("l_orderkey"), "orders", "lineitem"),
        integrity.violations(customer, "c_custkey", F.col("c_acctbal") < 0, "negative balance", "warning"),
    )
    return problems.groupBy("check", "level").agg(F.count("*").alias("n"))


@query("""SELECT (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)) AS errors, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS warnings,
 CASE WHEN (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)) > 0 THEN 2 WHEN (SELECT count(*) FROM customer WHERE c_acctbal < 0) > 0 THEN 1 ELSE 0 END AS exit_code""")
def kb_exit_code(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of an integrity run and its exit code."""
    keyed = table(spark, folder, "lineitem").withColumn("key", F.concat_ws(":", "l_orderkey", "l_linenumber"))
    return integrity.totals(integrity.report(integrity.duplicate_ids(keyed, "key", "lineitem"), integrity.violations(table(spark, folder, "customer"), "c_custkey", F.col("c_acctbal") < 0, "negative balance", "warning")))


@query("""WITH s AS (SELECT page_id, CASE WHEN starts_with(html, '<!DOCTYPE html') OR starts_with(html, '<html') THEN 'html' END AS t, page_id % 7 AS case_id, sha256(html) AS h,
 contains(html, '<script') OR contains(html, 'onclick') OR contains(html, '<iframe') AS hard, contains(html, '<style') OR contains(html, '<form') OR contains(html, '<nav') AS soft, length(trim(regexp_replace(html, '<[^>]*>', ' ', 'g'), ' ')) AS n FROM pages),
v AS (SELECT *, CASE WHEN t IS NULL OR hard THEN 'BLOCKED' WHEN soft THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict, row_number() OVER (PARTITION BY case_id, h ORDER BY page_id) > 1 AS dup, CASE WHEN n < 200 THEN 'REJECTED' WHEN n < 600 THEN 'DEGRADED' ELSE 'OK' END AS quality FROM s),
r AS (SELECT *, verdict <> 'BLOCKED' AND NOT dup AND quality <> 'REJECTED' AS ok FROM v)
SELECT case_id, count(*) AS submitted, count(*) FILTER (ok) AS accepted, count(*) FILTER (verdict = 'BLOCKED') AS blocked, count(*) FILTER (dup) AS duplicates, count(*) FILTER (quality = 'REJECTED') AS rejected_quality,
 count(*) FILTER (quality = 'DEGRADED') AS degraded, count(*) FILTER (ok AND n < 1000) AS needs_ocr FROM r GROUP BY 1""")
def ingest_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Pages through scan, duplicate check, routing and quality, counted by case."""
    n = F.length(F.trim(F.regexp_replace("html", "<[^>]*>", " ")))
    rows = safety_scan_pages(spark, folder).join(table(spark, folder, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), n.alias("n")), "page_id").withColumns({"case_id": F.col("page_id") % 7, "document_id": F.col("page_id"), "arrival": F.col("page_id")})
    routed = ingest.route(ingest.duplicates(rows))
    routed = routed.withColumns({"quality": F.when(F.col("n") < 200, "REJECTED").when(F.col("n") < 600, "DEGRADED").otherwise("OK"), "needs_ocr": F.col("n") < 1000})
    return ingest.ingest_summary(routed)
