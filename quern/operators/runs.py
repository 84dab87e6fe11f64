"""Reads over runs, searches and result links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import normalize_query
from quern.functions.urls import dedupe_key
from quern.operators.records import records


def first_links(links: DataFrame) -> DataFrame:
    """One link for each search and URL: the one with the lowest rank."""
    return links.groupBy("search_id", "url_id").agg(F.min("rank").alias("rank"))


def _is(column: str, value: str | None) -> Column | None:
    return F.col(column) == value if value is not None else None


def linked(spark: SparkSession, root: str, *search_columns: str, run_id: str | None = None, url: str | None = None) -> DataFrame:
    """Every link with its search and its URL: search_id, url_id, rank, url, domain, run_id and ``search_columns``.

    The links are the large side; they are reduced before either join. A run or a URL narrows the scans of
    searches and URLs.
    """
    links = first_links(records(spark, root, "search_urls", "search_id", "url_id", "rank"))
    searches = records(spark, root, "searches", "run_id", *search_columns, where=_is("run_id", run_id)).withColumnRenamed("id", "search_id")
    urls = records(spark, root, "urls", "url", "domain", where=_is("url", url)).withColumnRenamed("id", "url_id")
    return links.join(searches, "search_id").join(urls, "url_id")


def distinct_urls(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, url): the addresses that a run found, each once."""
    return linked(spark, root).select("run_id", "url").distinct()


def run_urls(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """(run_id, url_id, url, domain, best_rank): each address of a run at the best rank any search gave it."""
    return linked(spark, root, run_id=run_id).groupBy("run_id", "url_id", "url", "domain").agg(F.min("rank").alias("best_rank"))


def searches_finding_url(spark: SparkSession, root: str, url: str | None = None) -> DataFrame:
    """For every address, or for one, the searches that found it."""
    found = linked(spark, root, "term", "engine", "search_mode", url=url)
    return found.select("url", "search_id", "run_id", "term", "engine", "search_mode", "rank")


def list_runs(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """(id, mode, searches, urls, scrapes) of every run, or of one; counts are 0 where there is nothing."""
    runs = records(spark, root, "runs", "mode", where=_is("id", run_id))
    searches = records(spark, root, "searches", "run_id", where=_is("run_id", run_id)).groupBy("run_id").agg(F.count("*").alias("searches"))
    urls = linked(spark, root, run_id=run_id).groupBy("run_id").agg(F.count_distinct("url_id").alias("urls"))
    scrapes = records(spark, root, "scrape_cache", "run_id", where=_is("run_id", run_id)).where("run_id is not null").groupBy("run_id").agg(F.count("*").alias("scrapes"))
    out = runs.withColumnRenamed("id", "run_id")
    for counts in (searches, urls, scrapes):
        out = out.join(counts, "run_id", "left")
    return out.select(F.col("run_id").alias("id"), "mode", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("searches", "urls", "scrapes")])


def first_seen(spark: SparkSession, root: str) -> DataFrame:
    """(url_id, search_id, seen_us): the link that brought an address up first; ties go to the least search."""
    links = records(spark, root, "search_urls", "search_id", "url_id", "created_at")
    least = F.min(F.struct("created_at", "search_id")).alias("m")
    return links.groupBy("url_id").agg(least).select("url_id", "m.search_id", F.unix_micros("m.created_at").alias("seen_us"))


def ranked_results(spark: SparkSession, root: str) -> DataFrame:
    """(id, rank, url) of the stored results of each cached query, numbered from 1 in their order."""
    cache = records(spark, root, "search_cache", "results")
    return cache.select("id", F.posexplode("results").alias("pos", "r")).select("id", (F.col("pos") + 1).alias("rank"), "r.url")


def deduped_run_results(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, key, url): of the variants of an address in a run the one of the first term, then rank, is kept."""
    found = linked(spark, root, "term").withColumn("key", dedupe_key(F.col("url")))
    first = F.min(F.struct("term", "rank", "url")).alias("m")
    return found.groupBy("run_id", "key").agg(first).select("run_id", "key", "m.url")


def distinct_terms(spark: SparkSession, root: str) -> DataFrame:
    """(term, searches): terms that only differ in case and spacing count as one."""
    return records(spark, root, "searches", normalize_query(F.col("term")).alias("term")).groupBy("term").agg(F.count("*").alias("searches"))


def branches(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, search_id, position, url_id): the results of each search as a branch, by rank, then address."""
    order = Window.partitionBy("search_id").orderBy(F.col("rank").asc_nulls_last(), "url")
    return linked(spark, root).select("run_id", "search_id", F.row_number().over(order).alias("position"), "url_id")
