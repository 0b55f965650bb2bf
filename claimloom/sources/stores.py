"""Stores out: content by hash, recognised pages, reports, and search over a text corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from claimloom.functions.text import collapsed

CONTEXT, HITS = 320, 40


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def put_content(files: DataFrame, path: str) -> None:
    """Adds contents that the store hasn't got, once each. Writing again changes nothing."""
    new = files.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])
    if exists(files.sparkSession, path):
        new = new.join(files.sparkSession.read.parquet(path).select("sha256"), "sha256", "left_anti")
    new.write.mode("append").parquet(path)


def stored_once(spark: SparkSession, path: str) -> DataFrame:
    """The store's contents, one of each hash: two writers at once may both have added one."""
    return spark.read.parquet(path).dropDuplicates(["sha256"])


def get_content(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Contents of keys (sha256); null where the store has none."""
    return keys.join(stored_once(spark, path), "sha256", "left")


def cache_key(sha: str = "sha256", page: str = "page", engine: str = "engine", dpi: str = "dpi"):
    return F.concat_ws(":", F.lit("v1"), sha, page, engine, dpi)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cached pages; an absent or unreadable cache is an empty one, and a corrupt file holds no pages."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_report(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def markdown(title: str, rows: list[dict]) -> str:
    """A report's rows as a Markdown table."""
    if not rows:
        return f"# {title}\n\nNothing was measured.\n"
    names = list(rows[0])
    body = [" | ".join("" if r[n] is None else str(r[n]) for n in names) for r in rows]
    return "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *(f"| {b} |" for b in body), ""])


#: A document with more characters than this has a text layer.
LAYER_CHARS, HEAD_CHARS = 1000, 400


def dumped(pages: DataFrame, first: int, last: int | None = None, key: str = "doc") -> DataFrame:
    """Pages first to last (first alone without last) of each document, with n_pages."""
    counted = pages.groupBy(F.col(key).alias("of_")).agg(F.max("page").alias("n_pages"))
    kept = pages.where(F.col("page").between(max(1, first), last or first))
    return kept.join(counted, F.col(key) == F.col("of_")).select(key, "page", "n_pages", "text")


def identified(pages: DataFrame, key: str = "doc") -> DataFrame:
    """key, n_pages, text_chars, text_layer and head, the first page's beginning, of each document."""
    head = F.left(collapsed(F.coalesce(F.min_by("text", "page"), F.lit(""))), F.lit(HEAD_CHARS))
    chars = F.coalesce(F.sum(F.length("text")), F.lit(0))
    return pages.groupBy(key).agg(F.max("page").alias("n_pages"), chars.alias("text_chars"), (chars > LAYER_CHARS).alias("text_layer"), head.alias("head"))


def search(pages: DataFrame, pattern: str, keys: tuple[str, ...], limit: int | None = HITS) -> DataFrame:
    """Matches of a pattern in pages, white space collapsed, with context to either side; the limit is the caller's."""
    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rx = re.compile(pattern, re.IGNORECASE)
        for batch in batches:
            found = []
            for i, text in enumerate(batch.column(n).to_pylist()):
                text = " ".join((text or "").split())
                found += [(i, m.start(), m[0], text[max(0, m.start() - CONTEXT) : m.end() + CONTEXT]) for m in rx.finditer(text)]
            own = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(own) for j in range(n)), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string()), pa.array([f[3] for f in found], pa.string())], [*keys, "at", "hit", "context"])

    out = pages.select(*keys, "text").mapInArrow(of, f"{kinds}, at int, hit string, context string").orderBy(*keys, "at")
    return out.limit(limit) if limit else out
