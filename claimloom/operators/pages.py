"""Page text: which pages need OCR, how blocks make up a page, and which block an offset lies in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A page with this many characters has a usable text layer. Fixed value.
USABLE_CHARS = 20
BLOCK = "struct<text:string,x0:double,y0:double,x1:double,y1:double,confidence:double>"


def usable(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) >= USABLE_CHARS


def routed(pages: DataFrame, ocr_available: bool = True, text: str = "text") -> DataFrame:
    """pages with source: text_layer, ocr or empty. No page is dropped."""
    return pages.withColumn("source", F.when(usable(F.col(text)), "text_layer").when(F.lit(ocr_available), "ocr").otherwise("empty"))


def source_counts(pages: DataFrame, *keys: str) -> DataFrame:
    return pages.groupBy(*keys, "source").agg(F.count("*").alias("n"))


def flipped(top: Column, height: Column) -> Column:
    """A vertical position measured from the other edge."""
    return height - top


def assembled(blocks: DataFrame, *keys: str) -> DataFrame:
    """Page text from blocks (text, x0, y0, x1, y1, confidence) with spans.

    Empty blocks go; the rest are ordered by position, tenths of a point apart, and joined by line breaks. Blocks of the
    result have char_start and char_end.
    """
    own = F.struct(F.round("y0", 1).alias("y"), F.round("x0", 1).alias("x"), F.col("text"), F.struct("x0", "y0", "x1", "y1", "confidence").alias("at"))
    held = blocks.where(F.length(F.trim("text")) > 0).groupBy(*keys).agg(F.array_sort(F.collect_list(own)).alias("b"))
    before = F.transform("b", lambda _, i: F.aggregate(F.slice("b", F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x["text"]) + 1))
    spans = F.transform(F.arrays_zip(F.col("b"), before.alias("s")), lambda z: F.struct(z["b"]["text"].alias("text"), z["s"].alias("char_start"), (z["s"] + F.length(z["b"]["text"])).alias("char_end"), z["b"]["at"].alias("at")))
    scores = F.filter(F.transform("b", lambda x: x["at"]["confidence"]), lambda c: c.isNotNull())
    mean = F.when(F.size(scores) > 0, F.round(F.aggregate(scores, F.lit(0.0), lambda t, c: t + c) / F.size(scores), 4))
    return held.select(*keys, F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"), spans.alias("blocks"), mean.alias("mean_confidence"), F.array_min(scores).alias("min_confidence"))


def running_spans(blocks: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """char_start and char_end of blocks in long form: the running length, a separator after each."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0))
    return blocks.withColumn("char_start", start.cast("long")).withColumn("char_end", (start + F.length(text)).cast("long"))


def block_at(blocks: Column, offset: Column) -> Column:
    """The block that holds an offset: start included, end not."""
    return F.get(F.filter(blocks, lambda b: (b["char_start"] <= offset) & (offset < b["char_end"])), F.lit(0))


def blocks_for_span(blocks: Column, start: Column, end: Column) -> Column:
    """Blocks that overlap a span."""
    return F.filter(blocks, lambda b: (b["char_start"] < end) & (start < b["char_end"]))


def pending_ocr(pages: DataFrame, cache: DataFrame, keys: tuple[str, ...] = ("sha256", "page", "engine", "dpi")) -> DataFrame:
    """Pages that need OCR and have no cached result."""
    return pages.where(F.col("source") == "ocr").join(cache.select(*keys), list(keys), "left_anti")


def default_engine(make: Callable[[], Callable[[bytes], list[dict]]] | None) -> tuple[Callable[[bytes], list[dict]] | None, str | None]:
    """The engine that make builds, or none and why. Never raises: digital pages need no engine."""
    if make is None:
        return None, "no engine is configured"
    try:
        return make(), None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"


def recognised_images(images: DataFrame, engine: Callable[[bytes], list[dict]] | None, dpi: float = 200.0, key: str = "sha256") -> DataFrame:
    """Standalone images (key, content) as documents of one page, always by the engine, boxes in points; empty without one.

    key, page, source (ocr or empty), blocks, error.
    """
    scale = dpi / 72.0
    found = recognised(images.withColumn("page", F.lit(1)), engine, keys=(key, "page"))
    points = F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), *((b[c] / scale).alias(c) for c in ("x0", "y0", "x1", "y1")), b["confidence"].alias("confidence")))
    return found.select(key, "page", F.when(F.lit(engine is not None), "ocr").otherwise("empty").alias("source"), points.alias("blocks"), "error")


def recognised(pages: DataFrame, engine: Callable[[bytes], list[dict]] | None, content: str = "content", keys: tuple[str, ...] = ("document_id", "page")) -> DataFrame:
    """blocks of each page from an engine, a callable from page bytes to block dicts; without one, or where it fails, no blocks."""
    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, errors = [], []
            for data in batch[content]:
                try:
                    found.append(engine(data) if engine else [])
                    errors.append(None if engine else "no engine")
                except Exception as e:  # one page's failure is that page's row
                    found.append([])
                    errors.append(str(e))
            yield batch[list(keys)].assign(blocks=found, error=errors)

    return pages.select(*keys, content).mapInPandas(of, f"{kinds}, blocks array<{BLOCK}>, error string")
