"""The same results on streams: arrivals, duplicates, tasks that wait for people, feedback, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.verify import is_stale


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of parquet files as a stream; `path` may be one table."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def timed(stream: DataFrame, column: str = "ts") -> DataFrame:
    """A stream whose event time is a timestamp with time zone, as watermarks need."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def first_of_kind(stream: DataFrame, keys: list[str], column: str = "ts", within: str = "60 days") -> DataFrame:
    """The first row of each key within the watermark; state older than that goes."""
    return timed(stream, column).withWatermark(column, within).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, column: str = "ts", width: str = "1 day", slide: str | None = None, late: str = "1 hour", *keys: str) -> DataFrame:
    """Counts and sums by tumbling or sliding window."""
    window = F.window(column, width, slide) if slide else F.window(column, width)
    out = timed(stream, column).withWatermark(column, late).groupBy(window, *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, key: str, column: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events of a key without a gap."""
    out = timed(stream, column).withWatermark(column, late).groupBy(key, F.session_window(column, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def answered_tasks(tasks: DataFrame, observations: DataFrame, key: str, wait: str = "7 days") -> DataFrame:
    """Tasks with the observation that answers them within `wait`; an outer join, so unanswered ones come out as expired.

    tasks: key, opened_at. observations: key, seen_at.
    """
    a = tasks.withWatermark("opened_at", "1 hour").alias("t")
    b = observations.withWatermark("seen_at", "1 hour").alias("o")
    cond = (F.col(f"t.{key}") == F.col(f"o.{key}")) & (F.col("seen_at") >= F.col("opened_at")) & (F.col("seen_at") <= F.col("opened_at") + F.expr(f"interval {wait}"))
    return a.join(b, cond, "leftOuter").select(F.col(f"t.{key}").alias(key), "opened_at", "seen_at", F.when(F.col("seen_at").isNull(), "EXPIRED").otherwise("ANSWERED").alias("state"))


def freshness(observations: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """Observations (retrieved_at, record_as_of) with `stale`: older when fetched than their source allows. No state is kept.

    sources is the registry, of fixed size, so it is the side that is broadcast.
    """
    limits = F.broadcast(sources.select(F.col(key).alias("of_source_"), "freshness_days"))
    met = observations.join(limits, F.col(key) == F.col("of_source_"), "left")
    return met.withColumn("stale", is_stale(F.col("retrieved_at"), F.col("record_as_of"), F.col("freshness_days"))).drop("of_source_", "freshness_days")


def lapsed(records: DataFrame, key: str, seen: str, allowed, late: str = "1 hour") -> DataFrame:
    """key, since, lapsed_at and n of records that weren't renewed in time, once event time has passed that moment.

    allowed is how long a record stays fresh, an interval as text or a column. A session that ends is a record that has lapsed.
    """
    out = timed(records, seen).withWatermark(seen, late).groupBy(key, F.session_window(seen, allowed).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("since"), F.col("w.end").alias("lapsed_at"), "n")


def running_calibration(stream: DataFrame) -> DataFrame:
    """Correction counts by claimed confidence, for update or complete mode."""
    return stream.groupBy("original_confidence").agg(F.count("*").alias("reviewed"), F.count_if(F.col("action") == "correct").alias("corrected"))


def recompute_touched(stream: DataFrame, recompute: Callable[[DataFrame, int], None], checkpoint: str, key: str = "case_id"):
    """Starts a query that hands each batch's distinct cases to `recompute`, which rebuilds only those."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: recompute(batch.select(key).distinct(), epoch)).trigger(availableNow=True).start()


def collected(result: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """A stream's result over what is there now, as a table in memory: for tests and small reports."""
    query = result.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.table(name)


def latest_table(result: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """The whole result of a stream over what is there now as parquet, replaced with each batch: nothing is held by the driver."""
    result.sparkSession.createDataFrame([], result.schema).write.mode("overwrite").parquet(path)
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(path)
    result.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def to_table(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """A stream's result over what is there now, appended to parquet exactly once."""
    result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
