"""Counts and sizes of the store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import TIERS
from quern.operators import jobs
from quern.operators.records import records, zero_filled
from quern.runtime import cut

COUNTED = ("runs", "searches", "urls", "scrape_cache", "memory_facts", "search_cache")


def table_counts(spark: SparkSession, root: str) -> DataFrame:
    """(metric, value): the number of records of each table."""
    out = None
    for table in (*COUNTED, "vectors"):
        one = records(spark, root, table).agg(F.count("*").alias("value")).select(F.lit(table).alias("metric"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def scrape_sizes(spark: SparkSession, root: str) -> DataFrame:
    """One row: mean (rounded towards 0) and greatest number of characters of text and of raw HTML."""
    sizes = records(spark, root, "scrape_cache", F.length("text_content").alias("text"), F.length("raw_html").alias("raw"))
    mean = lambda c: F.coalesce(F.floor(F.avg(c)), F.lit(0)).cast("bigint")
    most = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("bigint")
    return sizes.agg(mean("text").alias("text_avg_chars"), most("text").alias("text_max_chars"), mean("raw").alias("raw_avg_chars"), most("raw").alias("raw_max_chars"))


def cache_stats(spark: SparkSession, root: str, table: str, now: datetime) -> DataFrame:
    """One row: rows, hits, rows with hits and expired rows of a cache."""
    rows = records(spark, root, table, "hit_count", "expires_at")
    return rows.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum("hit_count"), F.lit(0)).alias("total_hits"),
        F.count_if(F.col("hit_count") > 0).alias("rows_with_hits"),
        F.count_if(F.col("expires_at") < F.lit(now)).alias("expired"),
    )


def tier_counts(spark: SparkSession, root: str, table: str) -> DataFrame:
    """(tier, n) with a row for every known tier."""
    return zero_filled(records(spark, root, table, "tier").groupBy("tier").agg(F.count("*").alias("n")), "tier", TIERS)


def cache_profile(spark: SparkSession, root: str, table: str, now: datetime) -> DataFrame:
    """One row for each tier: rows, hits, rows with hits, expired rows; for pages also their sizes. One scan."""
    sizes = {"text": "text_content", "raw": "raw_html"} if table == "scrape_cache" else {}
    rows = records(spark, root, table, "tier", "hit_count", "expires_at", *[F.length(c).alias(n) for n, c in sizes.items()])
    measures = [F.count("*").alias("rows"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("total_hits"), F.count_if(F.col("hit_count") > 0).alias("rows_with_hits"), F.count_if(F.col("expires_at") < F.lit(now)).alias("expired")]
    for n in sizes:
        measures += [F.sum(n).alias(f"{n}_sum"), F.count(n).alias(f"{n}_count"), F.max(n).cast("bigint").alias(f"{n}_max")]
    return rows.groupBy("tier").agg(*measures)


def job_metrics(queue: DataFrame, sample: int) -> DataFrame:
    """(metric, value) of the queue: jobs by status, retries, backlog (null for none) and the mean run of the last ones."""
    shown = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(f"jobs.{c}").alias("metric"), F.col(c).cast("bigint").alias("value")) for c in df.columns])).alias("p")).select("p.metric", "p.value")
    by_status = jobs.status_counts(queue).select(F.concat(F.lit("jobs.status."), "status").alias("metric"), F.col("n").alias("value"))
    return by_status.unionByName(shown(jobs.summary(queue))).unionByName(shown(jobs.timing(queue, sample)))


def snapshot(spark: SparkSession, root: str, now: datetime, queue: DataFrame | None = None, sample: int = 200) -> DataFrame:
    """(metric, value) of everything the store can say about itself, and of its ``queue``; each cache is scanned once."""
    out = None
    for table in ("runs", "searches", "urls", "memory_facts", "vectors"):
        one = records(spark, root, table).agg(F.count("*").alias("value")).select(F.lit(table).alias("metric"), "value")
        out = one if out is None else out.unionByName(one)
    for table in ("search_cache", "scrape_cache"):
        profile = cut(cache_profile(spark, root, table, now))  # a row for each tier
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"{table}.{c}")  # noqa: B023, E731
        measures = [F.coalesce(F.sum("rows"), F.lit(0)).alias(table), *[total(c) for c in ("rows", "total_hits", "rows_with_hits", "expired")]]
        for n in ("text", "raw") if table == "scrape_cache" else ():
            mean = F.coalesce(F.floor(F.try_divide(F.sum(f"{n}_sum"), F.sum(f"{n}_count"))), F.lit(0)).cast("bigint")
            measures += [mean.alias(f"{n}_avg_chars"), F.coalesce(F.max(f"{n}_max"), F.lit(0)).cast("bigint").alias(f"{n}_max_chars")]
        one = profile.agg(*measures)
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("bigint").alias("value")) for c in one.columns]))
        out = out.unionByName(one.select(pairs.alias("p")).select("p.metric", "p.value"))
        tiers = zero_filled(profile.select("tier", F.col("rows").alias("n")), "tier", TIERS)
        out = out.unionByName(tiers.select(F.concat(F.lit(f"{table}.tier."), F.coalesce("tier", F.lit(""))).alias("metric"), F.col("n").alias("value")))
    return out if queue is None else out.unionByName(job_metrics(queue, sample))
