"""Case assembly: claims attach to one property, and people's claims to parties that are merged by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.binding import let
from claimloom.functions.names import match_tokens, split_name

# -- fixed values -----------------------------------------------------------------------
PARTY_ATTRIBUTES = ("party.owner", "party.seller", "party.buyer", "party.assessee", "party.mortgagor", "party.mortgagee")
MERGE_AT = 0.92

_PARTY = "struct<variants:array<string>,tokens:array<array<string>>,ids:array<string>>"
_KEPT = "struct<left:string,right:string,score:double>"


def party_claims(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("attribute").isin(*PARTY_ATTRIBUTES))


def merge_parties(claims: DataFrame) -> DataFrame:
    """A row for each party of each case and attribute: party_no, variants, claim_ids; and what was kept apart for review.

    Names are taken in order. A name joins the first party whose best variant matches it; partial matches with the parties
    before that one, or with any if there is none, are recorded and kept apart, so similarity never spreads from one variant
    to the next. Names of one case and attribute are few, so the fold stays within a row.
    """
    held = party_claims(claims).groupBy("case_id", "attribute").agg(F.array_sort(F.collect_list(F.struct("ord", "display", "claim_id"))).alias("names"))
    start = F.struct(F.array().cast(f"array<{_PARTY}>").alias("parties"), F.array().cast(f"array<{_KEPT}>").alias("kept"))

    def best(party: Column, tokens: Column) -> Column:
        """The best match of a name with a party's variants: score, then the variant's place."""

        def ranked(v: Column, i: Column) -> Column:
            return let(match_tokens(tokens, v), lambda m: F.struct(m["score"].alias("score"), (-i).alias("at"), m.alias("m")))

        return F.array_max(F.transform(party["tokens"], ranked))

    def step(state: Column, x: Column) -> Column:
        return let(split_name(x["display"]), lambda tokens: let(F.transform(state["parties"], lambda p: best(p, tokens)), lambda ranked: placed(state, x, tokens, ranked)))

    def placed(state: Column, x: Column, tokens: Column, ranked: Column) -> Column:
        at = F.array_position(F.transform(ranked, lambda r: (r["m"]["determination"] == "MATCH") & (r["m"]["score"] >= MERGE_AT)), F.lit(True))

        def joined(p: Column, i: Column) -> Column:
            here, new = i + 1 == at, ~F.array_contains(p["variants"], x["display"])
            return F.struct(
                F.when(here & new, F.array_append(p["variants"], x["display"])).otherwise(p["variants"]).alias("variants"),
                F.when(here & new, F.array_append(p["tokens"], tokens)).otherwise(p["tokens"]).alias("tokens"),
                F.when(here, F.array_append(p["ids"], x["claim_id"])).otherwise(p["ids"]).alias("ids"),
            )

        own = F.struct(F.array(x["display"]).alias("variants"), F.array(tokens).alias("tokens"), F.array(x["claim_id"]).alias("ids")).cast(_PARTY)
        parties = F.when(at > 0, F.transform(state["parties"], joined)).otherwise(F.concat(state["parties"], F.array(own)))
        close = F.transform(F.arrays_zip(state["parties"].alias("p"), ranked.alias("r")), lambda z: F.struct(x["display"].alias("left"), F.get(z["p"]["variants"], -z["r"]["at"]).alias("right"), z["r"]["m"]["score"].alias("score"), z["r"]["m"]["determination"].alias("d")))
        met = F.when(at > 0, F.slice(close, F.lit(1), at.cast("int"))).otherwise(close)
        partial = F.transform(F.filter(met, lambda c: c["d"] == "PARTIAL_MATCH"), lambda c: F.struct(c["left"], c["right"], c["score"]).cast(_KEPT))
        return F.struct(parties.cast(f"array<{_PARTY}>").alias("parties"), F.concat(state["kept"], partial).cast(f"array<{_KEPT}>").alias("kept"))

    folded = held.select("case_id", "attribute", F.aggregate("names", start, step).alias("s"))
    return folded.select("case_id", "attribute", F.col("s.kept").alias("kept_separate"), F.posexplode("s.parties").alias("party_no", "p")).select(
        "case_id", "attribute", (F.col("party_no") + 1).alias("party_no"), F.col("p.variants").alias("variants"), F.col("p.ids").alias("claim_ids"), "kept_separate"
    )


def with_party_claims(claims: DataFrame, merged: DataFrame) -> DataFrame:
    """claims of properties and, once more, people's claims with their party as subject: case, attribute and number name it."""
    party = F.concat(F.lit("PARTY_"), F.left(F.sha2(F.concat_ws("|", "case_id", "attribute", "party_no"), 256), F.lit(12)))
    owners = merged.select(F.col("case_id").alias("of_case_"), F.col("attribute").alias("of_attribute_"), party.alias("party_"), F.explode("claim_ids").alias("of_claim_"))
    same = (F.col("case_id") == F.col("of_case_")) & (F.col("attribute") == F.col("of_attribute_")) & (F.col("claim_id") == F.col("of_claim_"))
    theirs = party_claims(claims).join(owners, same).withColumn("subject_id", F.col("party_")).select(*claims.columns)
    return claims.unionByName(theirs)


def distinct_parties(merged: DataFrame) -> DataFrame:
    """How many parties a case has, and whether someone must look at similar names."""
    return merged.groupBy("case_id").agg(F.count("*").alias("n_parties"), F.bool_or(F.size("kept_separate") > 0).alias("needs_identity_review"))


def assembly_notes(documents: DataFrame, claims: DataFrame, missing: DataFrame, ungrounded: DataFrame) -> DataFrame:
    """case_id and note: too few contributing documents, missing fields, values that are not on their page, silent documents."""
    cases = documents.select("case_id").distinct()
    counted = cases.join(claims.groupBy("case_id").agg(F.count_distinct("document_id").alias("n")), "case_id", "left")
    few = counted.where(F.coalesce("n", F.lit(0)) < 2).select("case_id", F.lit("fewer than two documents contribute claims").alias("note"))
    lacking = missing.select("case_id", F.concat(F.col("document_id"), F.lit(": missing "), F.array_join("missing", ", ")).alias("note"))
    floating = ungrounded.groupBy("case_id", "document_id").agg(F.count("*").alias("n")).select("case_id", F.concat("document_id", F.lit(": "), "n", F.lit(" ungrounded")).alias("note"))
    silent = documents.join(claims.select("case_id", "document_id").distinct(), ["case_id", "document_id"], "left_anti").select("case_id", F.concat("document_id", F.lit(": nothing extracted")).alias("note"))
    return few.unionByName(lacking).unionByName(floating).unionByName(silent)
