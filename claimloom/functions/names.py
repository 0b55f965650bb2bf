"""People's names: normal form, tokens, phonetic keys, similarity and a greedy match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.binding import let

# -- fixed values -----------------------------------------------------------------------
HONORIFIC = r"(?i)^\s*(?:shri|sri|smt|smt\.|mr|mrs|ms|dr|late|m/s|messrs)\.?\s+"
HONORIFICS = ("shri", "sri", "shree", "smt", "smt.", "mr", "mrs", "ms", "dr", "late", "m/s", "messrs", "kum", "kumari", "shrimati")
RELATION = r"(?i)\b(?:s\s*/\s*o|d\s*/\s*o|w\s*/\s*o|c\s*/\s*o|son\s+of|daughter\s+of|wife\s+of)\b"
FOLDS = (("aa", "a"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("uu", "u"), ("ph", "f"), ("w", "v"), ("z", "j"), ("ksh", "x"), ("cch", "ch"))
MATCH_AT, PARTIAL_AT = 0.92, 0.75
INITIAL_SCORE, PHONETIC_SCORE = 0.85, 0.95


def normalise_name(raw: Column) -> Column:
    """Without one leading honorific; white space collapsed; ` ,.;:` trimmed at both ends."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), HONORIFIC, ""), r"\s+", " ")
    return F.regexp_replace(plain, r"^[ ,.;:]+|[ ,.;:]+$", "")


def split_name(name: Column) -> Column:
    """Lower-case tokens before a relation marker, without honorifics. Dots inside a token stay (`r.k.sharma` is one), those at its ends go."""
    own = F.get(F.split(F.coalesce(name, F.lit("")), RELATION, 2), F.lit(0))
    words = F.split(F.lower(F.regexp_replace(own, r"(?U)[^\w\s.]", " ")), r"\s+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.filter(bare, lambda w: (w != "") & ~w.isin(*HONORIFICS))


def phonetic_key(token: Column) -> Column:
    """Transliteration variants folded, then doubled letters collapsed."""
    out = F.lower(token)
    for old, new in FOLDS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, r"(.)\1+", "$1")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def token_match(a: Column, b: Column) -> Column:
    """How far two name tokens agree; an initial stands for a name that begins with it."""
    initial = (F.length(a) == 1) | (F.length(b) == 1)
    return (
        F.when(a == b, F.lit(1.0))
        .when(initial, F.when(F.left(a, F.lit(1)) == F.left(b, F.lit(1)), F.lit(INITIAL_SCORE)).otherwise(F.lit(0.0)))
        .when(phonetic_key(a) == phonetic_key(b), F.lit(PHONETIC_SCORE))
        .otherwise(similarity(a, b))
    )


def _greedy(left: Column, right: Column) -> Column:
    """Scores of left tokens, in order, each with its best remaining right token; the first of equals."""
    start = F.struct(right.alias("rest"), F.array().cast("array<double>").alias("scores"))

    def step(state: Column, token: Column) -> Column:
        ranked = F.transform(state["rest"], lambda c, i: F.struct(token_match(token, c).alias("score"), (-i).alias("at")))
        rest = lambda best: F.filter(state["rest"], lambda c, i: i != -best["at"])
        taken = let(F.array_max(ranked), lambda best: F.struct(rest(best).alias("rest"), F.concat(state["scores"], F.array(best["score"])).alias("scores")))
        return F.when(F.size(state["rest"]) == 0, state).otherwise(taken)

    return F.aggregate(left, start, step, lambda s: s["scores"])


def match_tokens(left: Column, right: Column) -> Column:
    """score and determination of two token arrays."""
    return let(F.struct(left.alias("l"), right.alias("r")), lambda s: _matched(s["l"], s["r"]))


def _matched(left: Column, right: Column) -> Column:
    swap = (F.size(right) == 1) & (F.size(left) > 1)
    a, b = F.when(swap, right).otherwise(left), F.when(swap, left).otherwise(right)

    def paired(s: Column) -> Column:
        mean = F.aggregate(s["scores"], F.lit(0.0), lambda t, x: t + x) / F.size(s["scores"])
        return F.round(mean * (0.7 + 0.3 * (F.size(s["scores"]) / s["most"])), 4)

    def scored(s: Column) -> Column:
        glued = F.when((F.size(s["a"]) == 1) & (F.size(s["b"]) > 1), token_match(F.get(s["a"], F.lit(0)), F.array_join(s["b"], "")))
        held = F.struct(glued.alias("glued"), _greedy(s["a"], s["b"]).alias("scores"), F.greatest(F.size(s["a"]), F.size(s["b"])).alias("most"))
        best = let(held, lambda h: F.when(h["glued"] >= MATCH_AT, h["glued"]).otherwise(paired(h)))
        return F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), F.lit(None).cast("double")).otherwise(best)

    def judged(score: Column) -> Column:
        outcome = F.when(score.isNull(), "NOT_DETERMINABLE").when(score >= MATCH_AT, "MATCH").when(score >= PARTIAL_AT, "PARTIAL_MATCH").otherwise("MISMATCH")
        return F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), outcome.alias("determination"))

    return let(let(F.struct(a.alias("a"), b.alias("b")), scored), judged)


def match_names(left: Column, right: Column) -> Column:
    """score and determination of two names. The pairing is greedy from the left, so sides are not interchangeable."""
    return match_tokens(split_name(left), split_name(right))
