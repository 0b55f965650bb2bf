"""Streams over events, run to the end of what is there; results equal their batch statements."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.plans.registry import query, table
from claimloom.streaming import streams


def _source(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The table's file as a stream: its folder, narrowed to that file."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _result(spark: SparkSession, result: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's output, appended to parquet exactly once or, in complete mode, replaced with each batch; read back."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(base or 'file://' + tempfile.mkdtemp(prefix='claimloom-stream-')).rstrip('/')}/stream-{uuid.uuid4().hex}"
    write = streams.latest_table if mode == "complete" else streams.to_table
    write(result, f"{path}/out", f"{path}/state")
    return spark.read.schema(result.schema).parquet(f"{path}/out")


@query("SELECT user_id, event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2")
def stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """The first event of each user and type, with state that ends with the watermark."""
    out = streams.first_of_kind(_source(spark, folder), ["user_id", "event_type"]).select("user_id", "event_type")
    return _result(spark, out).select("user_id", "event_type", F.lit(1).cast("long").alias("n"))


@query("SELECT CASE WHEN value > 50 THEN 'HIGH' ELSE 'LOW' END AS original_confidence, count(*) AS reviewed, count(*) FILTER (event_type = 'purchase') AS corrected FROM events GROUP BY 1")
def stream_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Running correction counts: the last state of a stateful aggregation."""
    rows = _source(spark, folder).select(F.when(F.col("value") > 50, "HIGH").otherwise("LOW").alias("original_confidence"), F.when(F.col("event_type") == "purchase", "correct").otherwise("accept").alias("action"))
    return _result(spark, streams.running_calibration(rows), "complete")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day and type: a windowed aggregation."""
    out = streams.windowed_counts(_source(spark, folder), "ts", "1 day", None, "1 hour", "event_type")
    return _result(spark, out, "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of a user's events without a gap of six hours."""
    out = streams.sessions(_source(spark, folder), "user_id", "ts", "6 hours")
    return _result(spark, out, "complete").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 DAY THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o),
l AS (SELECT user_id, min(ts) AS since, max(ts) + INTERVAL 2 DAY AS lapsed_at, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, strftime(lapsed_at, '%Y-%m-%d %H:%M:%S') AS lapsed_at, n FROM l WHERE lapsed_at <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_lapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Records that weren't renewed within two days, told when event time has passed that moment."""
    out = _result(spark, streams.lapsed(_source(spark, folder), "user_id", "ts", "2 days"))
    moment = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", moment("since"), moment("lapsed_at"), "n")


@query("""SELECT event_type AS source_id, count(*) AS n, count(*) FILTER (floor(epoch(TIMESTAMP '2024-02-01' - ts))::BIGINT > CASE event_type WHEN 'view' THEN 5 WHEN 'click' THEN 20 WHEN 'error' THEN 28 END * 86400) AS stale FROM events GROUP BY 1""")
def stream_freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Observations that were too old for their source when they were fetched; a source without a limit has none."""
    limits = spark.createDataFrame([("view", 5), ("click", 20), ("error", 28)], "source_id string, freshness_days int")
    fetched = F.to_timestamp(F.lit("2024-02-01"))
    rows = _source(spark, folder).select(F.col("event_type").alias("source_id"), F.col("ts").cast("timestamp").alias("record_as_of"), fetched.alias("retrieved_at"))
    out = _result(spark, streams.freshness(rows, limits))
    return out.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if("stale").alias("stale"))
