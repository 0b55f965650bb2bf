"""Session settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[8]", app: str = "claimloom", **more: str) -> SparkSession:
    """A session with the library's settings; `more` adds or overrides."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """df for work that costs more than moving its rows: dealt to all cores if its input would fill too few partitions.

    By the planner's estimate of its size, so nothing is run; a large table stays as it is.
    """
    session_ = df.sparkSession
    cores = session_.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    part = session_._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if size < cores * part else df
