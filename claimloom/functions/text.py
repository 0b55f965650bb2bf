"""Text: grounding, error rates, script counts, rendering, geometry, confidence, sharpness."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def squashed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def alnum(text: Column) -> Column:
    """Lower case, letters and digits alone."""
    return F.regexp_replace(F.lower(text), r"[^\p{Alnum}]", "")


def ground_tier(text: Column, value: Column) -> Column:
    """How value stands in text: exact, collapsed (white space), squashed (without any), or null."""
    held = (F.length(squashed(value)) > 0) & text.isNotNull()
    return F.when(held & F.contains(text, value), "exact").when(held & F.contains(collapsed(text), collapsed(value)), "collapsed").when(held & F.contains(squashed(text), squashed(value)), "squashed")


def exact_span(text: Column, value: Column) -> Column:
    """start and end (exclusive) of the first exact occurrence; null if there is none."""
    at = F.position(value, text)
    return F.when((at > 0) & (value != ""), F.struct((at - 1).alias("start"), (at - 1 + F.length(value)).alias("end")))


def locate(text: str | None, value: str | None) -> tuple[int, int] | None:
    """Span of value in text: as it is, else with any white space between its words, else between its characters."""
    if not text or not value or not value.split():
        return None
    for pattern in (re.escape(value), r"\s+".join(map(re.escape, value.split())), r"\s*".join(map(re.escape, "".join(value.split())))):
        if found := re.search(pattern, text):
            return found.span()
    return None


@F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
def located_span(texts: pd.Series, values: pd.Series) -> pd.DataFrame:
    """locate() for columns; meant for rows that the exact test has not settled."""
    found = [locate(t, v) or (None, None) for t, v in zip(texts, values, strict=True)]
    return pd.DataFrame(found, columns=["start", "end"]).astype("Int32")


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate, four decimals; null for an empty reference."""
    return F.round(F.try_divide(F.levenshtein(reference, hypothesis), F.length(reference)), 4)


def encode_tokens(tokens: Column, vocabulary: Column) -> Column:
    """Each token as one character beyond the basic plane, by its place in vocabulary; an error above MOST_TOKENS tokens."""
    letter = lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, t) + 0xFFFF), 8, "0")), "UTF-32")
    named = F.array_join(F.transform(tokens, letter), "")
    return F.when(F.size(vocabulary) <= MOST_TOKENS, named).otherwise(F.raise_error(F.lit(f"over {MOST_TOKENS} different tokens")))


#: Characters beyond the basic plane, one for each different token of two texts.
MOST_TOKENS = 0x100000


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word error rate, four decimals; null for a reference without words.

    Tokens are renamed to single characters, so that the built-in edit distance counts tokens.
    """
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    a, b = words(reference), words(hypothesis)
    vocabulary = F.array_union(a, b)
    return F.round(F.try_divide(F.levenshtein(encode_tokens(a, vocabulary), encode_tokens(b, vocabulary)), F.size(a)), 4)


def ocr_normalised(text: Column) -> Column:
    """White space collapsed and case folded, for error rates that forgive layout."""
    return F.lower(collapsed(text))


def script_counts(text: Column) -> Column:
    """devanagari, other_indic and latin letters of a text."""
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return F.struct(count(r"[\x{0900}-\x{097F}]").alias("devanagari"), count(r"[\x{0980}-\x{0DFF}]").alias("other_indic"), count("[A-Za-z]").alias("latin"))


def confidence_value(raw: Column) -> Column:
    """A number clamped to 0 to 1, four decimals; null if it is none."""
    value = raw.try_cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value), F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), 4))


def rendered(template: str, values: Column) -> Column:
    """A template with {names} filled from a map column; null if a name has no value.

    The template is cut once, on the driver, so that each row only concatenates.
    """
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(p) if i % 2 == 0 else F.try_element_at(values, F.lit(p)) for i, p in enumerate(parts)))


def quad_box(quad: Column, scale: float = 1.0) -> Column:
    """The box around a quadrilateral given as array<struct<x,y>>, divided by scale."""
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    return F.struct((F.array_min(xs) / scale).alias("x0"), (F.array_min(ys) / scale).alias("y0"), (F.array_max(xs) / scale).alias("x1"), (F.array_max(ys) / scale).alias("y1"))


def box_size(box: Column) -> Column:
    return F.struct((box["x1"] - box["x0"]).alias("width"), (box["y1"] - box["y0"]).alias("height"))


def sample_places(pages: Column, most: int = 5) -> Column:
    """Places of at most `most` evenly spaced pages out of `pages`, from 0."""
    every = F.sequence(F.lit(0), F.greatest(pages - 1, F.lit(0)))
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (pages - 1) / (most - 1), 0).cast("int")))
    return F.when(pages <= 0, F.array().cast("array<int>")).when(pages <= most, every).otherwise(spread)


@F.pandas_udf(T.DoubleType())
def sharpness(images: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Population variance of the four-neighbour Laplacian of gray images, given as rows of numbers; null under 3 x 3."""

    def one(rows) -> float | None:
        if rows is None or len(rows) < 3 or len(rows[0]) < 3:
            return None
        g = np.array([np.asarray(r, float) for r in rows])
        return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())

    for batch in images:
        yield batch.map(one).astype("float64")
