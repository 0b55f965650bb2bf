"""Corpus surveys: distributions and counts of many files in one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = 10


def spread(value: Column) -> Column:
    """n, min, p10, median, p90, max, two decimals, by linear interpolation; nulls don't count."""
    p = lambda q: F.round(F.percentile(value, F.lit(q)), 2)
    return F.struct(F.count(value).alias("n"), F.round(F.min(value), 2).alias("min"), p(0.1).alias("p10"), p(0.5).alias("median"), p(0.9).alias("p90"), F.round(F.max(value), 2).alias("max"))


def file_records(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Path, extension, size and hash of scanned files."""
    return files.select(path, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).alias("extension"), F.octet_length(content).alias("bytes"), F.sha2(content, 256).alias("sha256"))


def counted(rows: DataFrame, *dimensions: str) -> DataFrame:
    """Counts by each dimension apart: dimension, value, n. One aggregation with grouping sets."""
    sets = [[d] for d in dimensions]
    level = F.grouping_id(*dimensions)
    out = rows.groupingSets(sets, *dimensions).agg(F.count("*").alias("n"), level.alias("g"))
    whole = (1 << len(dimensions)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        is_it = F.col("g") == (whole ^ (1 << (len(dimensions) - 1 - i)))
        name, value = F.when(is_it, d).otherwise(name), F.when(is_it, F.col(d).cast("string")).otherwise(value)
    return out.select(name.alias("dimension"), value.alias("value"), "n")


def top(rows: DataFrame, column: str, limit: int = TOP) -> DataFrame:
    """The most frequent values; the limit is the report's."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(limit)


def survey(metrics: DataFrame, *keys: str) -> DataFrame:
    """Shares and counts over document metrics (see ingest.document_metrics)."""
    pct = lambda cond: F.round(F.try_divide(F.count_if(cond) * 100, F.count("*")), 2)
    return metrics.groupBy(*keys).agg(
        F.count("*").alias("documents"),
        pct(F.col("text_layer") == "DIGITAL").alias("pct_digital"),
        F.count_if(F.col("min_dpi") < 200).alias("under_200_dpi"),
        F.count_if(F.col("min_dpi") < 150).alias("under_150_dpi"),
        F.count_if(F.col("non_latin_ratio") > 0).alias("any_non_latin"),
        F.count_if(F.col("rotated_pages") > 0).alias("rotated"),
        F.count_if(F.col("distinct_page_sizes") > 1).alias("mixed_sizes"),
        spread(F.col("page_count")).alias("pages"),
        spread(F.col("median_chars")).alias("chars"),
    )
