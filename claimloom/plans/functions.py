"""Scalar functions over tables, each against an independent statement in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import areas, dates, money, names, text
from claimloom.operators import assemble
from claimloom.plans.registry import query, table
from claimloom.session import spread

_GROUPED = "array_to_string(list_concat([reverse(substr(reverse(head), (i * 2 + 1)::INT, 2)) FOR i IN list_reverse(generate_series(0, (length(head) + 1) // 2 - 1))], [right(digits, 3)]), ',')"


@query(f"""WITH o AS (SELECT o_orderkey, floor(o_totalprice * 37)::BIGINT AS rupees FROM orders), d AS (SELECT *, rupees::VARCHAR AS digits, left(rupees::VARCHAR, greatest(length(rupees::VARCHAR) - 3, 0)::INT) AS head FROM o)
SELECT o_orderkey, CASE WHEN head = '' THEN digits ELSE {_GROUPED} END AS formatted, rupees * 100 AS paise, CASE WHEN length(digits) <= 3 THEN 'ungrouped' ELSE 'indian' END AS style FROM d""")
def money_format_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts with Indian digit groups, read back with their style."""
    rupees = F.floor(F.col("o_totalprice") * 37).cast("long")
    formatted = money.format_indian(rupees)
    parsed = money.money_figures(F.concat(F.lit("paid Rs. "), formatted, F.lit("/- today")))
    return spread(table(spark, folder, "orders")).select("o_orderkey", formatted.alias("formatted"), parsed["paise"].alias("paise"), parsed["grouping"].alias("style"))


@query("SELECT o_orderkey, floor(o_totalprice * 997)::BIGINT AS rupees, (o_orderkey % 3 <> 0)::BOOLEAN AS agree FROM orders")
def number_words(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts in words, read back; and checked against figures, every third of which is off by one."""
    rupees = F.floor(F.col("o_totalprice") * 997).cast("long")
    figure = rupees + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)
    written = F.concat(F.lit("Rs. "), money.format_indian(figure), F.lit(" (Rupees "), money.in_words(rupees), F.lit(" only)"))
    rows = spread(table(spark, folder, "orders")).select("o_orderkey", written.alias("written")).select("o_orderkey", money.cross_check(F.col("written")).alias("c"))
    return rows.select("o_orderkey", F.col("c.words_rupees").alias("rupees"), F.col("c.agree").alias("agree"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS value, o_orderkey % 4 < 2 AND day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) AS ambiguous FROM orders""")
def date_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Dates in four written forms, read back, with a mark on those that depend on the order assumed."""
    form = F.col("o_orderkey") % 4
    day = F.col("o_orderdate").cast("date")
    written = (
        F.when(form == 0, F.date_format(day, "dd/MM/yyyy")).when(form == 1, F.date_format(day, "d-M-yy")).when(form == 2, F.concat(F.lit("executed on the "), F.date_format(day, "d"), F.lit("th day of "), F.date_format(day, "MMMM yyyy"))).otherwise(F.date_format(day, "ddMMMyyyy"))
    )
    parsed = dates.parse_date(written)
    return spread(table(spark, folder, "orders")).select("o_orderkey", parsed["value"].cast("string").alias("value"), parsed["ambiguous"].alias("ambiguous"))


@query("""WITH l AS (SELECT l_partkey, l_quantity::INT AS q, l_returnflag AS f, l_linestatus AS s FROM lineitem)
SELECT l_partkey, q AS value, CASE f WHEN 'A' THEN 'SQ_FT' WHEN 'N' THEN 'SQ_M' ELSE 'HECTARE' END AS unit, (round(q::DECIMAL(12,0) * CASE f WHEN 'A' THEN 0.09290304 WHEN 'N' THEN 1 ELSE 10000 END::DECIMAL(14,8), 6) * 1000000)::BIGINT AS sq_m_micro, CASE s WHEN 'F' THEN 'carpet' ELSE 'super_built_up' END AS basis, count(*) AS n FROM l GROUP BY ALL""")
def area_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Areas in text: number, unit, basis, and square metres."""
    flag = F.col("l_returnflag")
    unit = F.when(flag == "A", "sq. ft.").when(flag == "N", "square metres").otherwise("hectares")
    written = F.concat(F.when(F.col("l_linestatus") == "F", "Carpet area: ").otherwise("Super built-up area of "), F.col("l_quantity").cast("int"), F.lit(" "), unit)
    rows = spread(table(spark, folder, "lineitem").select("l_partkey", "l_quantity", "l_returnflag", "l_linestatus")).select("l_partkey", areas.parse_area(written).alias("a"))
    return rows.select("l_partkey", F.col("a.value").cast("int").alias("value"), "a.unit", (F.col("a.sq_m") * 1000000).cast("long").alias("sq_m_micro"), "a.basis").groupBy("l_partkey", "value", "unit", "sq_m_micro", "basis").agg(F.count("*").alias("n"))


def _fold_sql(x: str) -> str:
    out = f"lower({x})"
    for old, new in names.FOLDS:
        out = f"replace({out}, '{old}', '{new}')"
    for _ in range(2):
        for c in "abcdefghijklmnopqrstuvwxyz":
            out = f"replace({out}, '{c}{c}', '{c}')"
    return out


def _token_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN length({a}) = 1 OR length({b}) = 1 THEN CASE WHEN left({a}, 1) = left({b}, 1) THEN 0.85 ELSE 0 END WHEN f{a} = f{b} THEN 0.95 ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"


_NAMES = f"""n AS (SELECT DISTINCT p_name, lower(split_part(p_name, ' ', 1)) AS t1, lower(split_part(p_name, ' ', 2)) AS t2 FROM part),
m AS (SELECT p_name, t1, t2, {_fold_sql('t1')} AS ft1, {_fold_sql('t2')} AS ft2 FROM n),
p AS (SELECT a.p_name AS left_name, b.p_name AS right_name, a.t1 AS a1, a.t2 AS a2, b.t1 AS b1, b.t2 AS b2, a.ft1 AS fa1, a.ft2 AS fa2, b.ft1 AS fb1, b.ft2 AS fb2 FROM m a, m b WHERE a.p_name <> b.p_name),
s AS (SELECT *, {_token_sql('a1', 'b1')} AS s11, {_token_sql('a1', 'b2')} AS s12, {_token_sql('a2', 'b1')} AS s21, {_token_sql('a2', 'b2')} AS s22 FROM p)"""


def name_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of distinct part names; there are 64 of them at any scale, from a fixed vocabulary."""
    distinct = table(spark, folder, "part").select("p_name").distinct()
    return distinct.select(F.col("p_name").alias("left_name")).crossJoin(distinct.select(F.col("p_name").alias("right_name"))).where("left_name <> right_name")


@query(f"WITH {_NAMES} SELECT left_name, right_name, round(s11 * 1000000)::BIGINT AS first_micro, round(s22 * 1000000)::BIGINT AS second_micro, fa1 AS key FROM s")
def name_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Token scores of name pairs, and phonetic keys."""
    token = lambda c, i: F.lower(F.get(F.split(c, " "), F.lit(i)))
    score = lambda i: F.round(names.token_match(token("left_name", i), token("right_name", i)) * 1000000).cast("long")
    return name_pairs(spark, folder).select("left_name", "right_name", score(0).alias("first_micro"), score(1).alias("second_micro"), names.phonetic_key(token("left_name", 0)).alias("key"))


_MATCH = "round((CASE WHEN s11 >= s12 THEN s11 + s22 ELSE s12 + s21 END) / 2 * 10000)::BIGINT"


@query(f"WITH {_NAMES}, g AS (SELECT left_name, right_name, {_MATCH} AS score FROM s) SELECT left_name, right_name, score, CASE WHEN score >= 9200 THEN 'MATCH' WHEN score >= 7500 THEN 'PARTIAL_MATCH' ELSE 'MISMATCH' END AS determination FROM g")
def name_match_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy matches of all name pairs."""
    pairs = name_pairs(spark, folder).withColumn("m", names.match_names(F.col("left_name"), F.col("right_name")))
    return pairs.select("left_name", "right_name", F.round(F.col("m.score") * 10000).cast("long").alias("score"), "m.determination")


@query(f"WITH {_NAMES}, g AS (SELECT left_name, right_name, {_MATCH} AS score FROM s) SELECT left_name, arg_min(right_name, (-score, right_name)) AS best, max(score) AS score FROM g GROUP BY 1")
def name_best_match(spark: SparkSession, folder: str) -> DataFrame:
    """The best other name of each; ties to the first."""
    return name_match_greedy(spark, folder).groupBy("left_name").agg(F.min_by("right_name", F.struct(-F.col("score"), "right_name")).alias("best"), F.max("score").alias("score"))


@query()
def party_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Part names of each brand as owners' names: merged in order, similar ones kept apart for review."""
    parts = table(spark, folder, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("ord"))
    claims = parts.select(F.col("p_brand").alias("case_id"), F.lit("party.owner").alias("attribute"), "ord", F.col("p_name").alias("display"), F.col("ord").cast("string").alias("claim_id"))
    merged = assemble.merge_parties(claims)
    return merged.select("case_id", "attribute", "party_no", F.array_join("variants", "; ").alias("variants"), F.size("claim_ids").alias("n_claims"), F.size("kept_separate").alias("n_kept_separate"))


@query("""WITH b AS (SELECT item_id, text AS ref, regexp_replace(text, 'e', '#', 'g') AS hyp FROM benchmark), c AS (SELECT *, regexp_split_to_array(ref, '\\s+') AS rt, regexp_split_to_array(hyp, '\\s+') AS ht FROM b)
SELECT item_id, round(levenshtein(ref, hyp)::DOUBLE / length(ref) * 10000)::BIGINT AS cer, round(len(list_filter(list_zip(rt, ht), lambda z: z[1] <> z[2]))::DOUBLE / len(rt) * 10000)::BIGINT AS wer FROM c""")
def cer_wer(spark: SparkSession, folder: str) -> DataFrame:
    """Error rates of benchmark texts with a letter misread: a changed word is no word of the text, so the word rate is a count."""
    ref, hyp = F.col("text"), F.regexp_replace("text", "e", "#")
    as_long = lambda c: F.round(c * 10000).cast("long")
    return table(spark, folder, "benchmark").select("item_id", as_long(text.cer(ref, hyp)).alias("cer"), as_long(text.wer(ref, hyp)).alias("wer"))
