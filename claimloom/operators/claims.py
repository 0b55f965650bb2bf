"""Claims and what they establish.

A claim is a row: case_id, subject_id, attribute, claim_id, ord, kind, cmp_key, and for areas sq_m and basis; strength and
supersedes where they matter. Claims are never merged away: a resolution is a view over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.areas import TOLERANCE_PCT, within_tolerance
from claimloom.functions.money import format_indian
from claimloom.model import OWNERSHIP_STRENGTHS

SET = ["case_id", "subject_id", "attribute"]


def comparable_text(raw: Column, normalised: Column) -> Column:
    """The key by which texts agree: the normal form or else the raw one, trimmed, in lower case."""
    return F.lower(F.trim(F.coalesce(F.nullif(normalised, F.lit("")), raw)))


def parcel_key(id_type: Column, value: Column, locality: Column) -> Column:
    """TYPE|VALUE|LOCALITY: without white space and without -/. at the ends, in upper case."""
    plain = F.regexp_replace(F.regexp_replace(value, r"\s+", ""), r"^[-/.]+|[-/.]+$", "")
    return F.concat_ws("|", id_type, F.upper(plain), F.upper(F.coalesce(locality, F.lit(""))))


def append(claims: DataFrame, more: DataFrame, subject_id: str | None = None, attribute: str | None = None) -> DataFrame:
    """Claims are only ever added. With a subject or attribute, a claim of another set is an error."""
    for column, held in (("subject_id", subject_id), ("attribute", attribute)):
        if held is not None:
            stray = F.raise_error(F.concat(F.lit(f"claim of another {column} than {held}: "), F.coalesce(column, F.lit("null"))))
            more = more.withColumn(column, F.when(F.col(column) == held, F.col(column)).otherwise(stray))
    return claims.unionByName(more, allowMissingColumns=True)


def active(claims: DataFrame) -> DataFrame:
    """Claims that no claim of the same set supersedes."""
    gone = claims.where("supersedes is not null").select(*SET, F.col("supersedes").alias("claim_id"))
    return claims.join(gone, [*SET, "claim_id"], "left_anti")


def ownership_only(claims: DataFrame) -> DataFrame:
    """Claims from instruments that can establish ownership."""
    return claims.where(F.col("strength").isin(*OWNERSHIP_STRENGTHS))


def agrees(a: Column, b: Column, pct: float = TOLERANCE_PCT) -> Column:
    """Whether two claims agree: same kind; areas on comparable bases within tolerance, others with equal keys."""
    bases = (a["basis"] == b["basis"]) | (a["basis"] == "unspecified") | (b["basis"] == "unspecified")
    return (a["kind"] == b["kind"]) & F.when(a["kind"] == "area", bases & within_tolerance(a["sq_m"], b["sq_m"], pct)).otherwise(a["cmp_key"] == b["cmp_key"])


def clusters(claims: DataFrame, pct: float = TOLERANCE_PCT) -> DataFrame:
    """Agreement groups: the set's columns, kind, leader (its first value), first_ord and n.

    Exact kinds are one aggregation, combined before the shuffle. Areas agree only within tolerance, so they are folded in
    order: a claim joins the first group whose first member it agrees with. Equal areas join the same group, so they are
    counted first, and a subject's row holds its different areas alone.
    """
    exact = claims.where(F.col("kind") != "area").groupBy(*SET, "kind", F.col("cmp_key").alias("leader")).agg(F.min("ord").alias("first_ord"), F.count("*").alias("n"))
    # an area without size or basis does not agree with itself: such claims stay apart
    alone = F.when(F.col("sq_m").isNull() | F.col("basis").isNull(), F.monotonically_increasing_id())
    sized = claims.where(F.col("kind") == "area").withColumn("alone", alone).withColumn("sq_m", F.col("sq_m").cast("decimal(28,6)"))
    equal = sized.groupBy(*SET, "kind", "sq_m", "basis", "alone").agg(F.min(F.struct(F.col("ord").cast("bigint").alias("ord"), "cmp_key")).alias("first"), F.count("*").alias("n"))
    one = F.struct(F.col("first.ord").alias("ord"), F.col("sq_m"), F.col("basis"), F.col("first.cmp_key").alias("cmp_key"), F.col("n"))
    areas = equal.groupBy(*SET, "kind").agg(F.array_sort(F.collect_list(one)).alias("held"))

    def same(g: Column, x: Column) -> Column:
        return F.coalesce(((g["basis"] == x["basis"]) | (g["basis"] == "unspecified") | (x["basis"] == "unspecified")) & within_tolerance(g["sq_m"], x["sq_m"], pct), F.lit(False))

    def step(leaders: Column, x: Column) -> Column:
        return F.when(F.exists(leaders, lambda g: same(g, x)), leaders).otherwise(F.concat(leaders, F.array(x)))

    start = F.array().cast("array<struct<ord:bigint,sq_m:decimal(28,6),basis:string,cmp_key:string,n:bigint>>")
    led = areas.withColumn("leaders", F.aggregate("held", start, step))
    # leaders never change, so each claim's group is its own or the first of the final ones that it agrees with
    place = lambda x: F.coalesce(F.nullif(F.array_position("leaders", x), F.lit(0)), F.array_position(F.transform("leaders", lambda g: same(g, x)), F.lit(True)))
    joined = F.transform("held", lambda x: F.struct(place(x).alias("at"), x["n"].alias("n")))
    each = led.withColumn("joined", joined).select(*SET, "kind", "joined", F.posexplode("leaders").alias("no", "g"))
    members = F.aggregate(F.filter("joined", lambda j: j["at"] == F.col("no") + 1), F.lit(0).cast("bigint"), lambda n, j: n + j["n"])
    folded = each.select(*SET, "kind", F.col("g.cmp_key").alias("leader"), F.col("g.ord").alias("first_ord"), members.alias("n"))
    return exact.select(*SET, "kind", "leader", F.col("first_ord").cast("bigint").alias("first_ord"), "n").unionByName(folded)


def determination(total: Column, groups: Column) -> Column:
    """MISSING without claims, NOT_DETERMINABLE for a lone one, MATCH for one group, else MISMATCH."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, "MISSING").when(total == 1, "NOT_DETERMINABLE").when(groups == 1, "MATCH").otherwise("MISMATCH")


def resolution_confidence(outcome: Column) -> Column:
    return F.when(outcome == "MATCH", "HIGH").when(outcome == "NOT_DETERMINABLE", "LOW").otherwise("INSUFFICIENT")


def resolve(claims: DataFrame, required: DataFrame | None = None, pct: float = TOLERANCE_PCT) -> DataFrame:
    """What each set establishes: determination, value, n_claims, n_clusters, largest, dissent, confidence.

    The value is the largest group's, the earliest of equals. With `required` (the set's columns) every required set has a
    row, MISSING where nothing was claimed.
    """
    groups = clusters(claims, pct)
    best = F.max_by(F.struct("leader", "kind"), F.struct("n", (-F.col("first_ord")).alias("early")))
    out = groups.groupBy(*SET).agg(best.alias("best"), F.sum("n").alias("n_claims"), F.count("*").alias("n_clusters"), F.max("n").alias("largest"))
    if required is not None:
        out = required.select(*SET).distinct().join(out, SET, "left")
    out = out.withColumn("determination", determination(F.col("n_claims"), F.col("n_clusters")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return out.select(
        *SET,
        "determination",
        F.col("best.leader").alias("value"),
        F.col("best.kind").alias("kind"),
        zero("n_claims"),
        zero("n_clusters"),
        zero("largest"),
        (F.coalesce("n_claims", F.lit(0)) - F.coalesce("largest", F.lit(0))).cast("bigint").alias("dissent"),
        resolution_confidence(F.col("determination")).alias("confidence"),
    )


def supporting_ids(claims: DataFrame, resolutions: DataFrame) -> DataFrame:
    """For exact kinds, the ids that support each resolution's value and those that conflict with it."""
    joined = claims.join(resolutions.select(*SET, F.col("value").alias("held")), SET)
    ids = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("claim_id"))))
    return joined.groupBy(*SET).agg(ids(F.col("cmp_key") == F.col("held")).alias("supporting"), ids(F.col("cmp_key") != F.col("held")).alias("conflicting"))


def displayed(kind: Column, raw: Column, paise: Column, sq_m: Column, date_value: Column) -> Column:
    """A value as people read it: rupees with Indian groups, square metres, ISO dates, texts as they stand."""
    rupees = F.concat(F.lit("Rs. "), format_indian(F.floor(paise / 100).cast("long")))
    return F.when(kind == "money", rupees).when(kind == "area", F.concat(sq_m.cast("string"), F.lit(" sq m"))).when(kind == "date", date_value.cast("string")).otherwise(raw)


def lookup_value(kind: Column, raw: Column, cmp_key: Column, paise: Column) -> Column:
    """A value as a person or an interface can search for it: the parcel's own number, rupees without groups, raw text."""
    return F.when(kind == "parcel", F.get(F.split(cmp_key, r"\|"), F.lit(1))).when(kind == "money", (paise / 100).cast("long").cast("string")).when(kind == "text", raw).otherwise(cmp_key)


def share_identifier(a: Column, b: Column) -> Column:
    """Whether two arrays of parcel keys overlap."""
    return F.arrays_overlap(F.array_distinct(a), F.array_distinct(b))


def custody_inventory(documents: DataFrame) -> DataFrame:
    """Per case: documents by custody, and the types that are present or held in original."""
    return documents.groupBy("case_id").agg(
        F.count("*").alias("n_documents"),
        F.count_if(F.col("custody") == "original_held").alias("n_originals"),
        F.count_if(F.coalesce("quality", F.lit("OK")) != "REJECTED").alias("n_usable"),
        F.array_sort(F.collect_set("document_type")).alias("present"),
        F.array_sort(F.collect_set(F.when(F.col("custody") == "original_held", F.col("document_type")))).alias("originals"),
    )


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
