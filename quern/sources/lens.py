"""Queue and log tables in the shape of the data model, from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.runtime import read_table


def jobs(spark: SparkSession, root: str) -> DataFrame:
    """The events as a job queue; the payload stays opaque text."""
    e = read_table(spark, root, "events")
    status = F.element_at(F.array(*[F.lit(s) for s in ("pending", "running", "done", "failed")]), (F.col("event_id") % 4).cast("int") + 1)
    took = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(F.col("value"), 3))
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("type"),
        F.col("props").alias("payload"),
        status.alias("status"),
        (F.col("user_id") % 6).cast("int").alias("attempts"),
        F.col("ts").alias("run_after"),
        F.when(F.col("event_id") % 4 == 1, F.col("ts")).alias("locked_at"),
        F.col("ts").alias("created_at"),
        (F.col("ts") + took).alias("updated_at"),
    )


def logs(spark: SparkSession, root: str) -> DataFrame:
    """The events as log lines; a tenth of the users stands for lines without a run."""
    return log_rows(read_table(spark, root, "events"))


def log_rows(events: DataFrame) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warn").when(F.col("event_type") == "signup", "notice").otherwise("info")
    return events.select(
        F.col("event_id").alias("id"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("run_id"),
        level.alias("level"),
        F.when(F.col("event_id") % 2 == 0, "harvester").otherwise("scraper").alias("source"),
        F.col("props").alias("message"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
