"""The background queue: claims, retries, recovery, and its counts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.config import JOB_STATUSES, Jobs
from quern.functions.tiers import interval
from quern.operators.records import zero_filled


def enqueued(jobs: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """The queue with new jobs (id, type, payload), to run at once."""
    at = F.lit(now)
    rows = new.select("id", "type", "payload", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), at.alias("run_after"), F.lit(None).cast("timestamp").alias("locked_at"), at.alias("created_at"), at.alias("updated_at"))
    return jobs.unionByName(rows.select(*jobs.columns))


def claimable(jobs: DataFrame, now: datetime, limit: int) -> DataFrame:
    """The jobs that ``limit`` workers take next: pending and due, the longest due first."""
    return jobs.where((F.col("status") == "pending") & (F.col("run_after") <= F.lit(now))).orderBy("run_after", "id").limit(max(1, limit))


def claimed(jobs: DataFrame, now: datetime, limit: int) -> DataFrame:
    """The queue after a claim."""
    taken = F.broadcast(claimable(jobs, now, limit).select("id", F.lit(True).alias("__taken")))  # ``limit`` rows
    joined = jobs.join(taken, "id", "left")
    hit = F.col("__taken").isNotNull()
    return joined.withColumns({"status": F.when(hit, "running").otherwise(F.col("status")), "locked_at": F.when(hit, F.lit(now)).otherwise(F.col("locked_at")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))}).select(*jobs.columns)


def settled(jobs: DataFrame, outcomes: DataFrame, now: datetime, settings: Jobs = Jobs()) -> DataFrame:
    """The queue after outcomes (id, ok): done, pending again after attempts squared seconds, or failed."""
    at = F.lit(now)
    joined = jobs.join(outcomes.groupBy("id").agg(F.bool_or("ok").alias("__ok")), "id", "left")
    tries = F.col("attempts") + 1
    over, bad = F.col("__ok").isNotNull(), F.col("__ok") == False  # noqa: E712
    again = bad & (tries < settings.max_attempts)
    return joined.withColumns(
        {
            "status": F.when(F.col("__ok"), "done").when(again, "pending").when(bad, "failed").otherwise(F.col("status")),
            "attempts": F.when(again, tries).otherwise(F.col("attempts")),
            "run_after": F.when(again, at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), tries * tries)).otherwise(F.col("run_after")),
            "locked_at": F.when(over, None).otherwise(F.col("locked_at")),
            "updated_at": F.when(over, at).otherwise(F.col("updated_at")),
        }
    ).select(*jobs.columns)


def reaped(jobs: DataFrame, now: datetime, stale_after: timedelta = Jobs().stale_after) -> DataFrame:
    """The queue with running jobs whose lock is too old pending again."""
    stale = (F.col("status") == "running") & (F.col("locked_at") < F.lit(now) - interval(stale_after))
    return jobs.withColumns({"status": F.when(stale, "pending").otherwise(F.col("status")), "locked_at": F.when(stale, None).otherwise(F.col("locked_at")), "updated_at": F.when(stale, F.lit(now)).otherwise(F.col("updated_at"))})


def status_counts(jobs: DataFrame) -> DataFrame:
    """(status, n) with a row for every known status."""
    return zero_filled(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", JOB_STATUSES)


def timing(jobs: DataFrame, sample: int) -> DataFrame:
    """One row: of the ``sample`` jobs finished last, how many have sound times, and their mean run in whole ms."""
    last = jobs.where("status = 'done'").orderBy(F.col("updated_at").desc(), F.col("id").desc()).limit(sample)
    took = (F.unix_micros("updated_at") - F.unix_micros("created_at")) / 1000
    sound = last.where("updated_at >= created_at")
    return sound.agg(F.count("*").alias("sampled"), F.coalesce(F.floor(F.floor(F.sum(took)) / F.nullif(F.count("*"), F.lit(0))), F.lit(0)).cast("bigint").alias("avg_ms"))


def summary(jobs: DataFrame) -> DataFrame:
    """One row: retried jobs, most attempts, creation of the longest waiting one in microseconds (null for none)."""
    return jobs.agg(F.count_if(F.col("attempts") > 1).alias("retried"), F.coalesce(F.max("attempts"), F.lit(0)).cast("bigint").alias("max_attempts"), F.min(F.when(F.col("status") == "pending", F.unix_micros("created_at"))).alias("oldest_pending_us"))


def current(events: DataFrame, order: str = "updated_at") -> DataFrame:
    """Current state of an append-only log of job rows."""
    last = Window.partitionBy("id").orderBy(F.col(order).desc())
    return events.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
