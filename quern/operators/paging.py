"""Filtered, ordered pages of the browsable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.options import clamp_page
from quern.operators.records import micros, records
from quern.runtime import all_of, newest, read_table


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Rows ``offset``.. of ``df`` in a total order; Spark takes the top rows of each partition only."""
    size, skip = clamp_page(limit, offset)
    return df.orderBy(*order).offset(skip).limit(size)


def holds(column: str, part: str | None) -> Column | None:
    """Case-insensitive search for a part; ``%`` and ``_`` in it are wildcards. None for no part."""
    return F.col(column).ilike(f"%{part}%") if part else None


def equals(column: str, value: str | None) -> Column | None:
    return F.col(column) == value if value else None


def facts(spark: SparkSession, root: str, q: str | None = None, tier: str | None = None) -> DataFrame:
    """Facts by optional part of the text and tier."""
    rows = records(spark, root, "memory_facts", "text", "source_url", "volatility", "tier", "hit_count", "created_at", "expires_at")
    return rows.where(all_of([holds("text", q), equals("tier", tier)]))


def facts_page(spark: SparkSession, root: str, q: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Newest facts first."""
    out = page(facts(spark, root, q), [F.col("created_at").desc(), F.col("id").desc()], limit, offset)
    return out.select("id", "text", F.coalesce("source_url", F.lit("")).alias("source_url"), "tier", "hit_count", micros("created_at").alias("created_us"))


def cached_searches(spark: SparkSession, root: str, tier: str | None = None, q: str | None = None) -> DataFrame:
    """Cached queries with the number of their results instead of the results."""
    rows = records(spark, root, "search_cache", "query", "query_norm", "tier", "hit_count", F.coalesce(F.size("results"), F.lit(0)).alias("result_count"), "fetched_at")
    part = " ".join(q.lower().split()) if q else None  # the form that queries are stored in
    return rows.where(all_of([equals("tier", tier), holds("query_norm", part)]))


def cached_searches_page(spark: SparkSession, root: str, tier: str | None = None, q: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Newest fetched first."""
    out = page(cached_searches(spark, root, tier, q), [F.col("fetched_at").desc(), F.col("id").desc()], limit, offset)
    return out.select("id", "query", "query_norm", "tier", "hit_count", "result_count", micros("fetched_at").alias("fetched_us"))


def cached_pages(spark: SparkSession, root: str, tier: str | None = None, q: str | None = None, run_id: str | None = None) -> DataFrame:
    """Cached pages without their bodies, which are not read."""
    fixed = all_of([holds("url", q), equals("run_id", run_id)])  # alike in all deliveries of a page, so asked of the scan
    rows = records(spark, root, "scrape_cache", "url", "run_id", "http_status", "title", "tier", "hit_count", "fetched_at", where=fixed)
    return rows.where(all_of([equals("tier", tier)]))


def cached_pages_page(spark: SparkSession, root: str, tier: str | None = None, q: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Newest fetched first, with sizes.

    The rows of the page are found without bodies; their ids, 500 at most, then go to the scan as a filter, so
    that sizes are only worked out where row groups can hold one of them.
    """
    newest_first = [F.col("fetched_at").desc(), F.col("id").desc()]
    top = page(cached_pages(spark, root, tier, q), newest_first, limit, offset)
    ids = [r.id for r in top.select("id").collect()]
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("bigint")
    bodies = read_table(spark, root, "scrape_cache").where(F.col("id").isin(ids))
    sized = bodies.select("id", "updated_at", "url", F.coalesce("http_status", F.lit(0)).alias("http_status"), "title", "tier", size("text_content").alias("text_chars"), size("clean_html").alias("clean_chars"), size("raw_html").alias("raw_chars"), "fetched_at")
    payload = [c for c in sized.columns if c not in ("id", "updated_at")]
    out = newest(sized, "id", "updated_at", *payload).orderBy(*newest_first)
    return out.select("id", *payload[:-1], micros("fetched_at").alias("fetched_us"))
