"""Where an address came from and what came of it: provenance and causality."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.config import NODE_KINDS, Observability
from quern.operators.records import records, zero_filled
from quern.operators.runs import linked
from quern.runtime import cut


def fact_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Ids of the facts that have a vector."""
    return records(spark, root, "vectors").where("owner_kind = 'memory'").select("id").distinct()


def facts_with_presence(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """(id, source_url, ``columns``, has_vector) of every fact."""
    marked = fact_vectors(spark, root).withColumn("v", F.lit(True))
    return records(spark, root, "memory_facts", "source_url", *columns).join(marked, "id", "left").select("id", "source_url", *columns, F.col("v").isNotNull().alias("has_vector"))


def url_provenance(spark: SparkSession, root: str, url: str | None = None) -> DataFrame:
    """For every address that is registered, scraped or a source of facts, or for one: what led to it and what came of it.

    The three sides are reduced to one row for each address before they meet, so no address is a hot key.
    """
    only = F.col("url") == url if url is not None else None
    found = linked(spark, root, url=url).groupBy("url").agg(F.count("*").alias("found_by"), F.min("rank").alias("best_rank"))
    known = records(spark, root, "urls", "url", where=only).groupBy("url").agg(F.min("id").alias("url_id"))
    scraped = records(spark, root, "scrape_cache", "url", where=only).groupBy("url").agg(F.min("id").alias("scrape_id"))
    facts = facts_with_presence(spark, root).where(F.col("source_url") == url if url is not None else F.col("source_url").isNotNull()).groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("facts"), F.count_if("has_vector").alias("facts_with_vector"))
    joined = known.join(scraped, "url", "full_outer").join(found, "url", "left").join(facts, "url", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("url", "url_id", "scrape_id", zero("found_by"), zero("best_rank"), zero("facts"), zero("facts_with_vector"), (F.col("url_id").isNotNull() | F.col("scrape_id").isNotNull()).alias("known"))


def capped_links(spark: SparkSession, root: str, most: int, run_id: str | None = None) -> DataFrame:
    """The first ``most`` links of each run by rank and address, and whether there were more.

    The cap bounds the graph of a run; it is applied with a group limit before the sort.
    """
    order = Window.partitionBy("run_id").orderBy("rank", "url", "search_id")
    ranked = linked(spark, root, "term", "engine", "search_mode", run_id=run_id).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most + 1)
    return ranked.withColumn("truncated", F.max("n").over(Window.partitionBy("run_id")) > most).where(F.col("n") <= most)


class Graph(NamedTuple):
    """Nodes (run_id, id, kind, ref_id, label, detail, has_vector), edges (run_id, source, target, rank) and (run_id, links, truncated)."""

    nodes: DataFrame
    edges: DataFrame
    cut: DataFrame


def causality(spark: SparkSession, root: str, most: int = Observability().causality_max_urls, run_id: str | None = None) -> Graph:
    """The graph of every run, or of one, and which runs have more links than ``most``."""
    links = cut(capped_links(spark, root, most, run_id))  # the join of the large tables runs once for all that follows
    urls = links.select("run_id", "url_id", "url").distinct()
    scrapes = urls.join(records(spark, root, "scrape_cache", "url", "title", "http_status").withColumnRenamed("id", "scrape_id"), "url")
    facts = facts_with_presence(spark, root, "text", "volatility").where("source_url is not null")
    sourced = urls.join(facts.select(F.col("id").alias("fact_id"), "text", "volatility", "has_vector", F.col("source_url").alias("url")), "url")
    node = lambda kind, ref: F.concat(F.lit(f"{kind}:"), ref)
    searches = records(spark, root, "searches", "run_id", "term", "engine", "search_mode", where=F.col("run_id") == run_id if run_id is not None else None)
    no = F.lit(False).alias("has_vector")
    nodes = (
        searches.select("run_id", node("search", F.col("id")).alias("id"), F.lit("search").alias("kind"), F.col("id").alias("ref_id"), F.concat_ws(" · ", "engine", "term").alias("label"), F.col("search_mode").alias("detail"), no)
        .unionByName(urls.select("run_id", node("url", F.col("url_id")).alias("id"), F.lit("url").alias("kind"), F.col("url_id").alias("ref_id"), F.col("url").alias("label"), F.lit("").alias("detail"), no))
        .unionByName(scrapes.select("run_id", node("scrape", F.col("scrape_id")).alias("id"), F.lit("scrape").alias("kind"), F.col("scrape_id").alias("ref_id"), F.coalesce(F.nullif("title", F.lit("")), "url").alias("label"), F.format_string("HTTP %d", F.coalesce("http_status", F.lit(0))).alias("detail"), no).distinct())
        .unionByName(sourced.select("run_id", node("fact", F.col("fact_id")).alias("id"), F.lit("fact").alias("kind"), F.col("fact_id").alias("ref_id"), F.col("text").alias("label"), F.coalesce("volatility", F.lit("")).alias("detail"), "has_vector").distinct())
    )
    none = F.lit(0).alias("rank")
    edges = (
        links.select("run_id", node("search", F.col("search_id")).alias("source"), node("url", F.col("url_id")).alias("target"), "rank")
        .unionByName(scrapes.select("run_id", node("url", F.col("url_id")).alias("source"), node("scrape", F.col("scrape_id")).alias("target"), none))
        .unionByName(sourced.select("run_id", node("url", F.col("url_id")).alias("source"), node("fact", F.col("fact_id")).alias("target"), none))
    )
    return Graph(nodes, edges, links.groupBy("run_id").agg(F.count("*").alias("links"), F.bool_or("truncated").alias("truncated")))


def node_counts(nodes: DataFrame) -> DataFrame:
    """(kind, n) with a row for every kind."""
    return zero_filled(nodes.groupBy("kind").agg(F.count("*").alias("n")), "kind", NODE_KINDS)


def tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, search, path): the graph as paths search / url / scrape or fact; a shared address shows under each search.

    Edges without both nodes are left out, addresses that nothing leads to don't show.
    """
    ids = nodes.select("run_id", F.col("id").alias("target")).distinct()
    sound = edges.join(ids, ["run_id", "target"], "left_semi")
    first = sound.where("source like 'search:%'").select("run_id", F.col("source").alias("search"), F.col("target").alias("url"))
    second = sound.where("source like 'url:%'").select("run_id", F.col("source").alias("url"), F.col("target").alias("leaf"))
    joined = first.join(second, ["run_id", "url"], "left")
    return joined.select("run_id", "search", F.concat_ws("/", "url", "leaf").alias("path"))


def fact_sources(spark: SparkSession, root: str) -> DataFrame:
    """(id, source_url, text_chars, note): every fact with the size of its source, or why there is none."""
    sizes = records(spark, root, "scrape_cache", "url", F.length("text_content").cast("bigint").alias("text_chars"))
    one = sizes.groupBy("url").agg(F.max("text_chars").alias("text_chars"), F.lit(True).alias("cached"))
    facts = records(spark, root, "memory_facts", "source_url")
    note = F.when(F.col("source_url").isNull(), "no source recorded").when(F.col("cached").isNull(), "source not cached").otherwise("")
    return facts.join(one, facts.source_url == one.url, "left").select("id", "source_url", F.coalesce("text_chars", F.lit(0)).alias("text_chars"), note.alias("note"))
