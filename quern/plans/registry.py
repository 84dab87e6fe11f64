"""Named queries over whole tables, each with the SQL that gives the same rows.

Names begin with the row of the operator inventory that they stand for.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import Settings
from quern.functions import html, text, tiers, urls
from quern.operators import jobs, lifecycle, paging, provenance, runs, stats, vectors
from quern.operators.records import micros, records
from quern.runtime import current_rows, ensure_checkpoint_dir, read_table
from quern.sources import lens
from quern.sources.models import StubEmbedder, embedded
from quern.streaming import logs as log_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
EVENT_NOW = datetime(2024, 1, 15, tzinfo=timezone.utc)
SETTINGS = Settings()
_AT, _EVENT_AT = "TIMESTAMPTZ '2026-01-01 00:00:00+00'", "TIMESTAMP '2024-01-15 00:00:00'"


def once(table: str) -> str:
    """SQL of the records of a table."""
    return f"(SELECT DISTINCT ON (id) * FROM {table})"


def newest(table: str) -> str:
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, and its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


_RUNS, _SEARCHES, _URLS, _LINKS = once("runs"), once("searches"), once("urls"), once("search_urls")
_PAGES, _FACTS, _CACHE = newest("scrape_cache"), newest("memory_facts"), newest("search_cache")
_LINKED = f"""WITH links AS (SELECT search_id, url_id, min(rank) AS rank FROM {_LINKS} GROUP BY ALL),
linked AS (SELECT l.*, s.run_id, s.term, s.engine, s.search_mode, u.url, u.domain FROM links l JOIN {_SEARCHES} s ON s.id = l.search_id JOIN {_URLS} u ON u.id = l.url_id)
"""
_VECTORS = """(SELECT owner_kind, id, CAST(arg_max(embedding, created_at) AS DOUBLE[]) AS v FROM vectors
 WHERE model = 'emb-v1' AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY owner_kind, id)"""
_JOBS = """(SELECT CAST(event_id AS VARCHAR) AS id, event_type AS type, props AS payload, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS status,
 CAST(user_id % 6 AS INT) AS attempts, ts AS run_after, CASE WHEN event_id % 4 = 1 THEN ts END AS locked_at, ts AS created_at, ts + to_microseconds(CAST(round(round(value, 3) * 1000000) AS BIGINT)) AS updated_at FROM events)"""
_LOGS = """(SELECT event_id AS id, CASE WHEN user_id % 10 <> 0 THEN user_id END AS run_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'notice' ELSE 'info' END AS level,
 CASE WHEN event_id % 2 = 0 THEN 'harvester' ELSE 'scraper' END AS source, props AS message, ts AS created_at FROM events)"""


# ---- scans, lookups, projections, filters


@query("SELECT id, CAST(json_object('id', id, 'mode', mode) AS VARCHAR) AS json FROM " + _RUNS)
def a12_runs_json(spark: SparkSession, root: str) -> DataFrame:
    """Rows as JSON."""
    return records(spark, root, "runs", "mode").select("id", F.to_json(F.struct("id", "mode")).alias("json"))


@query(
    f"""SELECT s.id AS search_id, c.id AS cache_id, c.id IS NOT NULL AND (c.expires_at IS NULL OR {_AT} <= c.expires_at) AS fresh
FROM {_SEARCHES} s LEFT JOIN {_CACHE} c ON c.query_norm = trim(regexp_replace(lower(s.term), '\\s+', ' ', 'g'))"""
)
def a4_cache_lookup(spark: SparkSession, root: str) -> DataFrame:
    """Exact lookup of every searched term in the query cache, by its normalised form."""
    searches = records(spark, root, "searches", "term").select(F.col("id").alias("search_id"), text.normalize_query(F.col("term")).alias("query_norm"))
    cache = records(spark, root, "search_cache", "query_norm", "expires_at", "fetched_at").withColumnRenamed("id", "cache_id")
    alive = F.col("cache_id").isNotNull() & tiers.fresh(F.lit(NOW), F.col("expires_at"), F.col("fetched_at"))
    return searches.join(cache, "query_norm", "left").select("search_id", "cache_id", alive.alias("fresh"))


@query(f"SELECT id, coalesce(landed_url, '') AS landed_url, coalesce(http_status, 0) AS http_status, coalesce(error, '') AS error, engine || ' · ' || term AS label FROM {_SEARCHES}")
def b2_search_rows(spark: SparkSession, root: str) -> DataFrame:
    """Searches with defaults for what is missing, and a label."""
    rows = records(spark, root, "searches", "landed_url", "http_status", "error", "engine", "term")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("id", empty("landed_url"), F.coalesce("http_status", F.lit(0)).alias("http_status"), empty("error"), F.concat_ws(" · ", "engine", "term").alias("label"))


@query(f"SELECT id, CAST(coalesce(length(text_content), 0) AS BIGINT) AS text_chars, CAST(coalesce(strlen(text_content), 0) AS BIGINT) AS text_bytes, CAST(coalesce(length(raw_html), 0) AS BIGINT) AS raw_chars FROM {_PAGES}")
def b3_page_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Sizes of every page in characters and in bytes; only the sizes are shuffled."""
    size = lambda f, c: F.coalesce(f(c), F.lit(0)).cast("bigint")
    return records(spark, root, "scrape_cache", size(F.length, "text_content").alias("text_chars"), size(F.octet_length, "text_content").alias("text_bytes"), size(F.length, "raw_html").alias("raw_chars"))


@query(f"SELECT id, CAST(coalesce(len(results), 0) AS INT) AS result_count FROM {_CACHE}")
def b12_result_counts(spark: SparkSession, root: str) -> DataFrame:
    """Number of stored results instead of the results."""
    return records(spark, root, "search_cache", F.coalesce(F.size("results"), F.lit(0)).alias("result_count"))


@query(f"SELECT id FROM {_FACTS} WHERE text ILIKE '%library%' AND tier = 'short'")
def c2_filtered_facts(spark: SparkSession, root: str) -> DataFrame:
    """Facts by optional predicates; what isn't asked for doesn't filter."""
    return paging.facts(spark, root, q="library", tier="short").select("id")


@query(f"SELECT id FROM {_PAGES} WHERE url ILIKE '%/wiki/%'")
def c3_pages_by_part(spark: SparkSession, root: str) -> DataFrame:
    """Pages whose address holds a part, in any case."""
    return paging.cached_pages(spark, root, q="/wiki/").select("id")


# ---- joins over runs, searches, links


@query(_LINKED + "SELECT DISTINCT run_id, url FROM linked")
def d1_run_distinct_urls(spark: SparkSession, root: str) -> DataFrame:
    """Addresses that each run found."""
    return runs.distinct_urls(spark, root)


@query(_LINKED + "SELECT run_id, url_id, url, domain, min(rank) AS best_rank FROM linked GROUP BY ALL")
def d2_run_urls(spark: SparkSession, root: str) -> DataFrame:
    """Addresses of each run at their best rank."""
    return runs.run_urls(spark, root)


@query(_LINKED + "SELECT url, search_id, run_id, term, engine, search_mode, rank FROM linked")
def d3_searches_finding_url(spark: SparkSession, root: str) -> DataFrame:
    """Searches that found each address."""
    return runs.searches_finding_url(spark, root)


@query(
    _LINKED
    + f"""SELECT r.id, r.mode, (SELECT count(*) FROM {_SEARCHES} s WHERE s.run_id = r.id) AS searches, (SELECT count(DISTINCT url_id) FROM linked l WHERE l.run_id = r.id) AS urls,
(SELECT count(*) FROM {_PAGES} p WHERE p.run_id = r.id) AS scrapes FROM {_RUNS} r"""
)
def d12_list_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs with their numbers of searches, addresses and pages."""
    return runs.list_runs(spark, root)


@query(f"SELECT f.id, f.source_url, EXISTS (SELECT 1 FROM vectors v WHERE v.owner_kind = 'memory' AND v.id = f.id) AS has_vector FROM {_FACTS} f")
def d8_fact_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Which facts have a vector."""
    return provenance.facts_with_presence(spark, root)


@query(
    f"""WITH p AS (SELECT url, CAST(max(length(text_content)) AS BIGINT) AS text_chars FROM {_PAGES} GROUP BY url)
SELECT f.id, f.source_url, coalesce(p.text_chars, 0) AS text_chars, CASE WHEN f.source_url IS NULL THEN 'no source recorded' WHEN p.url IS NULL THEN 'source not cached' ELSE '' END AS note
FROM {_FACTS} f LEFT JOIN p ON p.url = f.source_url"""
)
def d11_fact_sources(spark: SparkSession, root: str) -> DataFrame:
    """Facts with the size of their source."""
    return provenance.fact_sources(spark, root)


@query(f"SELECT DISTINCT v.owner_kind, v.id FROM vectors v WHERE NOT EXISTS (SELECT 1 FROM {_FACTS} f WHERE v.owner_kind = 'memory' AND f.id = v.id) AND NOT EXISTS (SELECT 1 FROM {_CACHE} c WHERE v.owner_kind = 'search' AND c.id = v.id)")
def d15_orphan_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Vectors whose owner is gone."""
    return vectors.orphans(records(spark, root, "vectors"), _owners(spark, root))


# ---- aggregates


@query("SELECT metric, value FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS metric, count(DISTINCT id) AS value FROM {t}" for t in stats.COUNTED) + " UNION ALL SELECT 'vectors', count(*) FROM (SELECT DISTINCT owner_kind, id, model FROM vectors))")
def e1_table_counts(spark: SparkSession, root: str) -> DataFrame:
    """Number of records of each table."""
    return stats.table_counts(spark, root)


@query(f"SELECT t.tier, coalesce(n, 0) AS n FROM (VALUES ('short'), ('long'), ('permanent')) t(tier) LEFT JOIN (SELECT tier, count(*) AS n FROM {_FACTS} GROUP BY tier) c USING (tier)")
def e3_fact_tiers(spark: SparkSession, root: str) -> DataFrame:
    """Facts by tier, every tier shown."""
    return stats.tier_counts(spark, root, "memory_facts")


@query(f"SELECT CAST(floor(avg(length(text_content))) AS BIGINT) AS text_avg_chars, max(length(text_content)) AS text_max_chars, CAST(floor(avg(length(raw_html))) AS BIGINT) AS raw_avg_chars, max(length(raw_html)) AS raw_max_chars FROM {_PAGES}")
def e8_scrape_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Mean and greatest sizes of pages."""
    return stats.scrape_sizes(spark, root)


@query(f"SELECT count(*) AS rows, CAST(sum(hit_count) AS BIGINT) AS total_hits, count(*) FILTER (hit_count > 0) AS rows_with_hits, count(*) FILTER (expires_at < {_AT}) AS expired FROM {_PAGES}")
def e10_page_cache_stats(spark: SparkSession, root: str) -> DataFrame:
    """Hits and expiries of the page cache."""
    return stats.cache_stats(spark, root, "scrape_cache", NOW)


def _profile_sql(table: str, rows: str) -> str:
    parts = [f"SELECT '{table}' AS metric, count(*) AS value FROM {rows}", f"SELECT '{table}.rows', count(*) FROM {rows}", f"SELECT '{table}.total_hits', CAST(coalesce(sum(hit_count), 0) AS BIGINT) FROM {rows}", f"SELECT '{table}.rows_with_hits', count(*) FILTER (hit_count > 0) FROM {rows}", f"SELECT '{table}.expired', count(*) FILTER (expires_at < {_AT}) FROM {rows}"]
    parts += [f"SELECT '{table}.tier.{t}', count(*) FILTER (tier = '{t}') FROM {rows}" for t in ("short", "long", "permanent")]
    return " UNION ALL ".join(parts)


@query(
    "SELECT metric, value FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS metric, count(DISTINCT id) AS value FROM {t}" for t in ("runs", "searches", "urls", "memory_facts"))
    + " UNION ALL SELECT 'vectors', count(*) FROM (SELECT DISTINCT owner_kind, id, model FROM vectors) UNION ALL "
    + _profile_sql("search_cache", _CACHE)
    + " UNION ALL "
    + _profile_sql("scrape_cache", _PAGES)
    + "".join(f" UNION ALL SELECT '{n}_avg_chars', CAST(floor(avg(length({c}))) AS BIGINT) FROM {_PAGES} UNION ALL SELECT '{n}_max_chars', CAST(max(length({c})) AS BIGINT) FROM {_PAGES}" for n, c in (("text", "text_content"), ("raw", "raw_html")))
    + ")"
)
def e13_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Everything the store can say about itself, as metrics."""
    return stats.snapshot(spark, root, NOW)


@query(
    f"""WITH jobs AS {_JOBS}, last AS (SELECT * FROM jobs WHERE status = 'done' ORDER BY updated_at DESC, id DESC LIMIT 200)
SELECT 'jobs.status.' || status AS metric, count(*) AS value FROM jobs GROUP BY status
UNION ALL SELECT 'jobs.retried', count(*) FILTER (attempts > 1) FROM jobs UNION ALL SELECT 'jobs.max_attempts', max(attempts) FROM jobs UNION ALL SELECT 'jobs.oldest_pending_us', min(epoch_us(created_at)) FROM jobs WHERE status = 'pending'
UNION ALL SELECT 'jobs.sampled', count(*) FROM last WHERE updated_at >= created_at UNION ALL SELECT 'jobs.avg_ms', CAST(floor(floor(sum(epoch_us(updated_at) - epoch_us(created_at)) / 1000) / count(*)) AS BIGINT) FROM last WHERE updated_at >= created_at"""
)
def e13_job_metrics(spark: SparkSession, root: str) -> DataFrame:
    """The queue's part of the snapshot."""
    return stats.job_metrics(lens.jobs(spark, root), SETTINGS.observability.job_timing_sample)


@query(f"SELECT url_id, arg_min(search_id, (created_at, search_id)) AS search_id, epoch_us(min(created_at)) AS seen_us FROM {_LINKS} GROUP BY url_id")
def f4_first_seen(spark: SparkSession, root: str) -> DataFrame:
    """The link that brought each address up first."""
    return runs.first_seen(spark, root)


@query(f"SELECT id, CAST(r AS INT) AS rank, results[r].url AS url FROM (SELECT id, results, unnest(range(1, len(results) + 1)) AS r FROM {_CACHE})")
def f5_ranked_results(spark: SparkSession, root: str) -> DataFrame:
    """Stored results numbered in their order."""
    return runs.ranked_results(spark, root)


@query(_LINKED + "SELECT domain AS host, count(DISTINCT url_id) AS urls, min(rank) AS best_rank FROM linked GROUP BY domain")
def e15_host_groups(spark: SparkSession, root: str) -> DataFrame:
    """Found addresses by host."""
    return runs.linked(spark, root).groupBy(F.col("domain").alias("host")).agg(F.count_distinct("url_id").alias("urls"), F.min("rank").alias("best_rank"))


@query(f"SELECT run_id, CASE WHEN count(DISTINCT fetched_with) = 0 THEN 'live' WHEN count(DISTINCT fetched_with) = 1 THEN min(fetched_with) ELSE 'mixed' END AS source FROM {_PAGES} WHERE run_id IS NOT NULL GROUP BY run_id")
def e16_combined_sources(spark: SparkSession, root: str) -> DataFrame:
    """How the pages of each run were fetched: one way, or mixed."""
    rows = records(spark, root, "scrape_cache", "run_id", "fetched_with").where("run_id is not null")
    ways = rows.groupBy("run_id").agg(F.count_distinct("fetched_with").alias("n"), F.min("fetched_with").alias("one"))
    return ways.select("run_id", F.when(F.col("n") == 0, "live").when(F.col("n") == 1, F.col("one")).otherwise("mixed").alias("source"))


# ---- pages of the browsable tables


@query(f"SELECT id, text, coalesce(source_url, '') AS source_url, tier, hit_count, epoch_us(created_at) AS created_us FROM {_FACTS} ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10")
def g2_facts_page(spark: SparkSession, root: str) -> DataFrame:
    """A page of facts, newest first."""
    return paging.facts_page(spark, root, offset=10)


@query(f"SELECT id, query, query_norm, tier, hit_count, CAST(coalesce(len(results), 0) AS INT) AS result_count, epoch_us(fetched_at) AS fetched_us FROM {_CACHE} ORDER BY fetched_at DESC, id DESC LIMIT 50")
def g2_search_cache_page(spark: SparkSession, root: str) -> DataFrame:
    """A page of cached queries; a size above 500 is the default size."""
    return paging.cached_searches_page(spark, root, limit=501)


@query(
    f"""SELECT id, url, coalesce(http_status, 0) AS http_status, title, tier, CAST(coalesce(length(text_content), 0) AS BIGINT) AS text_chars, CAST(coalesce(length(clean_html), 0) AS BIGINT) AS clean_chars,
CAST(coalesce(length(raw_html), 0) AS BIGINT) AS raw_chars, epoch_us(fetched_at) AS fetched_us FROM {_PAGES} ORDER BY fetched_at DESC, id DESC LIMIT 100"""
)
def g2_scrape_cache_page(spark: SparkSession, root: str) -> DataFrame:
    """A page of cached pages."""
    return paging.cached_pages_page(spark, root, limit=100)


@query(_LINKED + "SELECT run_id, search_id, CAST(row_number() OVER (PARTITION BY search_id ORDER BY rank NULLS LAST, url) AS INT) AS position, url_id FROM linked")
def g11_branches(spark: SparkSession, root: str) -> DataFrame:
    """Results of each search as a branch, best rank first."""
    return runs.branches(spark, root)


@query(f"SELECT 'memory' AS owner_kind, id, text AS label FROM {_FACTS} UNION ALL SELECT 'search', id, query FROM {_CACHE}")
def h1_owners(spark: SparkSession, root: str) -> DataFrame:
    """All that a vector can belong to."""
    return _owners(spark, root).select("owner_kind", "id", "label")


# ---- vectors


def _owners(spark: SparkSession, root: str) -> DataFrame:
    return vectors.owners(records(spark, root, "memory_facts", "text", "source_url"), records(spark, root, "search_cache", "query"))


def _asked(spark: SparkSession, root: str, k: int, kind: str | None = "search") -> DataFrame:
    """The k nearest of each kind for the query set: vectors of a kind, or of all, whose id, as a number, is divisible by 50."""
    known = vectors.current(read_table(spark, root, "vectors", ["id", "owner_kind", "embedding", "model", "created_at"]))
    asked = (known if kind is None else known.where(F.col("owner_kind") == kind)).where(vectors.id_number() % 50 == 0)
    return vectors.search(known, asked.select("id", "embedding"), k)


_ASKED = f"""WITH known AS {_VECTORS},
asked AS (SELECT id AS query_id, v AS q FROM known WHERE owner_kind = 'search' AND CAST('0x' || right(id, 8) AS BIGINT) % 50 = 0),
scored AS (SELECT query_id, owner_kind, id, round(1 - list_cosine_similarity(q, v), 5) + 0.0 AS distance FROM asked, known),
found AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, owner_kind ORDER BY distance, id) AS INT) AS position FROM scored QUALIFY position <= {{k}})
"""


_ASKED_ALL = _ASKED.replace("owner_kind = 'search' AND ", "")


@query(_ASKED_ALL.format(k=8) + "SELECT query_id, owner_kind, id, distance, position FROM found")
def i1_vector_search(spark: SparkSession, root: str) -> DataFrame:
    """The 8 nearest vectors of each kind for the query set of both kinds, against all vectors."""
    return _asked(spark, root, 8, None)


@query("SELECT a.vec_id AS query_id, b.vec_id AS id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) + 0.0 AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY distance, b.vec_id) <= 5")
def i1_embedding_search(spark: SparkSession, root: str) -> DataFrame:
    """The 5 nearest of all embeddings for every id divisible by 50."""
    e = read_table(spark, root, "embeddings", ["vec_id", "embedding"])
    rows = e.select(F.lit("memory").alias("owner_kind"), F.format_string("%020d", "vec_id").alias("id"), "embedding")  # ids in the order of their numbers
    asked = e.where("vec_id % 50 = 0").select(F.format_string("%020d", "vec_id").alias("id"), "embedding")
    found = vectors.search(rows, asked, 5)
    return found.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("id").cast("bigint").alias("id"), "distance")


@query(f"SELECT m.id, round(1 - list_cosine_similarity(m.v, n.v), 5) + 0.0 AS distance FROM {_VECTORS} m JOIN {_VECTORS} n ON n.owner_kind = m.owner_kind AND n.id = (SELECT min(id) FROM {_VECTORS} k WHERE k.owner_kind = m.owner_kind)")
def i1_distance_to_first(spark: SparkSession, root: str) -> DataFrame:
    """Distance of every vector to the first of its kind, by expressions alone."""
    known = vectors.current(read_table(spark, root, "vectors", ["id", "owner_kind", "embedding", "model", "created_at"]))
    first = known.groupBy("owner_kind").agg(F.min_by("embedding", "id").alias("first"))
    return known.join(first, "owner_kind").select("id", (F.round(vectors.cosine_distance(F.col("embedding"), F.col("first")), 5) + 0.0).alias("distance"))


@query(_ASKED.format(k=8) + f"SELECT query_id, f.id, f.text, round(1 - distance, 5) AS similarity FROM found JOIN {_FACTS} f ON f.id = found.id WHERE owner_kind = 'memory' AND round(1 - distance, 5) >= 0.3")
def i6_retrieved_facts(spark: SparkSession, root: str) -> DataFrame:
    """Facts near the query set, at a similarity that the data reaches."""
    return vectors.retrieved_facts(_asked(spark, root, 8), records(spark, root, "memory_facts", "text"), 0.3)


@query(_ASKED.format(k=8) + f"SELECT query_id, string_agg('- ' || f.text, chr(10) ORDER BY distance, f.id) AS joined FROM found JOIN {_FACTS} f ON f.id = found.id WHERE owner_kind = 'memory' AND round(1 - distance, 5) >= 0.3 GROUP BY query_id")
def e17_joined_facts(spark: SparkSession, root: str) -> DataFrame:
    """Retrieved facts of each query as one text, nearest first; at most k of them."""
    found = vectors.retrieved_facts(_asked(spark, root, 8), records(spark, root, "memory_facts", "text"), 0.3)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "id", F.concat(F.lit("- "), "text").alias("t"))))
    return found.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n").alias("joined"))


@query(
    _ASKED.format(k=8)
    + f"""SELECT query_id, arg_min(c.id, (distance, c.id)) AS id, arg_min(c.query_norm, (distance, c.id)) AS query_norm, min(distance) AS distance FROM found JOIN {_CACHE} c ON c.id = found.id
WHERE owner_kind = 'search' AND round(1 - distance, 5) >= 0.85 AND (c.expires_at IS NULL OR {_AT} <= c.expires_at) GROUP BY query_id"""
)
def i7_semantic_cache(spark: SparkSession, root: str) -> DataFrame:
    """The nearest fresh cached query for each of the query set."""
    cache = records(spark, root, "search_cache", "query_norm", "expires_at", "fetched_at")
    return vectors.cached_answers(_asked(spark, root, 8), cache, SETTINGS.memory.similarity_threshold, NOW)


@query(
    _ASKED_ALL.format(k=10)
    + f""", known_owners AS (SELECT 'memory' AS owner_kind, id, text AS label FROM {_FACTS} UNION ALL SELECT 'search', id, query FROM {_CACHE})
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, owner_kind, id) AS INT) AS place, owner_kind, id, distance, label FROM found JOIN known_owners USING (owner_kind, id) QUALIFY place <= 10"""
)
def i9_explore(spark: SparkSession, root: str) -> DataFrame:
    """The 10 nearest of both kinds together for the query set, with what they are."""
    return vectors.explore(_asked(spark, root, 10, None), _owners(spark, root), 10)


@query(f"WITH known AS {_VECTORS} SELECT v.owner_kind, v.id, o.label FROM (SELECT * FROM known ORDER BY owner_kind, id LIMIT 2000) v JOIN (SELECT 'memory' AS owner_kind, id, text AS label FROM {_FACTS} UNION ALL SELECT 'search', id, query FROM {_CACHE}) o USING (owner_kind, id)")
def i10_projection_page(spark: SparkSession, root: str) -> DataFrame:
    """A page of vectors for the projection, with labels; orphans drop out after the cut."""
    known = vectors.current(read_table(spark, root, "vectors", ["id", "owner_kind", "embedding", "model", "created_at"]))
    top = known.orderBy("owner_kind", "id").limit(SETTINGS.observability.projection_sample_cap)
    return top.join(_owners(spark, root), ["owner_kind", "id"]).select("owner_kind", "id", "label")


@query("SELECT owner_kind, count(*) AS n FROM (SELECT DISTINCT owner_kind, id, model FROM vectors) GROUP BY owner_kind")
def i11_vector_totals(spark: SparkSession, root: str) -> DataFrame:
    """Vectors by kind."""
    return vectors.totals(records(spark, root, "vectors"))


@query()
def i12_projection(spark: SparkSession, root: str) -> DataFrame:
    """All vectors on their two main axes, fitted into a box."""
    known = vectors.current(read_table(spark, root, "vectors", ["id", "owner_kind", "embedding", "model", "created_at"]))
    return vectors.scaled_to_box(vectors.project(known))


@query(
    _ASKED.format(k=8)
    + f"""SELECT query_id, f.id, round(1 - distance, 5) AS similarity FROM found JOIN {_FACTS} f ON f.id = found.id WHERE owner_kind = 'memory' AND round(1 - distance, 5) >= 0.3 AND (f.expires_at IS NULL OR {_AT} <= f.expires_at)
AND (coalesce(lower(trim(f.volatility)), '') NOT IN ('time-sensitive', 'volatile', 'time_sensitive') OR f.fetched_at + INTERVAL 24 HOUR >= {_AT})"""
)
def i15_gated_facts(spark: SparkSession, root: str) -> DataFrame:
    """Facts that pass the gates of similarity, expiry and age."""
    facts = records(spark, root, "memory_facts", "volatility", "expires_at", "fetched_at")
    return vectors.gated_facts(_asked(spark, root, 8), facts, 0.3, NOW)


@query(f"SELECT id, CASE WHEN lower(trim(volatility)) IN ('time-sensitive', 'volatile', 'time_sensitive') THEN 24 ELSE 0 END AS max_age_hours FROM {_FACTS}")
def i16_volatility(spark: SparkSession, root: str) -> DataFrame:
    """Greatest age of each fact in hours; 0 for none."""
    return records(spark, root, "memory_facts", tiers.volatility_hours(F.col("volatility")).alias("max_age_hours"))


@query(f"SELECT f.id, 'memory' AS owner_kind, 8 AS dim FROM {_FACTS} f WHERE trim(text) <> '' UNION ALL SELECT id, 'search', 8 FROM {_CACHE} WHERE trim(query) <> ''")
def i17_reembedded(spark: SparkSession, root: str) -> DataFrame:
    """A new generation of vectors for all owners, by the stub model."""
    stub = StubEmbedder()
    facts = embedded(records(spark, root, "memory_facts", "text"), stub, "memory")
    return facts.unionByName(embedded(records(spark, root, "search_cache", "query"), stub, "search", "query")).select("id", "owner_kind", F.size("embedding").alias("dim"))


# ---- lifecycle


@query(f"SELECT search_id, url_id, min(rank) AS rank FROM {_LINKS} GROUP BY ALL")
def j2_first_links(spark: SparkSession, root: str) -> DataFrame:
    """One link for each search and address: insert or ignore, lowest rank first."""
    links = records(spark, root, "search_urls", "search_id", "url_id", "rank").select("search_id", "url_id", "rank")
    return lifecycle.insert_or_ignore(spark.createDataFrame([], links.schema), links, ["search_id", "url_id"], "rank")


_TERMS = f"(SELECT trim(regexp_replace(lower(term), '\\s+', ' ', 'g')) AS query_norm, min(term) AS query, count(*) AS n FROM {_SEARCHES} GROUP BY 1)"


@query(
    f"""SELECT coalesce(c.id, 'new:' || sha256(t.query_norm)) AS id, coalesce(t.query_norm, c.query_norm) AS query_norm, CASE WHEN t.query_norm IS NULL THEN c.query ELSE t.query END AS query,
CASE WHEN t.query_norm IS NULL THEN c.tier ELSE 'short' END AS tier, CASE WHEN t.query_norm IS NULL THEN c.hit_count ELSE 0 END AS hit_count,
CASE WHEN t.query_norm IS NULL THEN coalesce(epoch_us(c.expires_at), 0) ELSE epoch_us({_AT} + INTERVAL 240 HOUR) END AS expires_us FROM {_CACHE} c FULL JOIN {_TERMS} t USING (query_norm)"""
)
def j5_stored_searches(spark: SparkSession, root: str) -> DataFrame:
    """The query cache after an answer for every searched term: ids stay, hits and window begin anew."""
    cache = records(spark, root, "search_cache", "query_norm", "query", "results", "tier", "hit_count", "expires_at", "fetched_at", "created_at", F.col("updated_at"))
    terms = records(spark, root, "searches", "term").groupBy(text.normalize_query(F.col("term")).alias("query_norm")).agg(F.min("term").alias("query"))
    answers = terms.select("query_norm", "query", F.lit(None).cast(dict(cache.dtypes)["results"]).alias("results"), F.lit("short").alias("tier"))
    out = lifecycle.stored_searches(cache, answers, NOW)
    return out.select("id", "query_norm", "query", "tier", "hit_count", F.coalesce(micros("expires_at"), F.lit(0)).alias("expires_us"))


@query(
    f"""WITH hits AS (SELECT c.id, t.n FROM {_CACHE} c JOIN {_TERMS} t USING (query_norm)),
moved AS (SELECT c.id, c.tier, h.n IS NOT NULL AS hit, CAST(c.hit_count + coalesce(h.n, 0) AS INT) AS hit_count, c.expires_at FROM {_CACHE} c LEFT JOIN hits h USING (id)),
risen AS (SELECT *, CASE WHEN hit AND tier = 'short' AND hit_count >= 3 THEN 'long' ELSE tier END AS new_tier FROM moved)
SELECT id, hit_count, new_tier AS tier, CASE WHEN NOT hit THEN coalesce(epoch_us(expires_at), 0) WHEN new_tier = 'permanent' THEN 0 WHEN new_tier = 'long' THEN epoch_us({_AT} + INTERVAL 1080 HOUR) ELSE epoch_us({_AT} + INTERVAL 240 HOUR) END AS expires_us FROM risen"""
)
def j7_touched_searches(spark: SparkSession, root: str) -> DataFrame:
    """The query cache after every search hit it: hits, promotion and sliding expiry."""
    cache = records(spark, root, "search_cache", "query_norm", "tier", "hit_count", "expires_at")
    terms = records(spark, root, "searches", "term").groupBy(text.normalize_query(F.col("term")).alias("query_norm")).agg(F.count("*").alias("n"))
    hits = cache.select("id", "query_norm").join(terms, "query_norm").select("id", "n")
    return lifecycle.touched(cache, hits, NOW).select("id", "hit_count", "tier", F.coalesce(micros("expires_at"), F.lit(0)).alias("expires_us"))


@query(f"SELECT id, CASE WHEN tier = 'short' AND hit_count >= 3 THEN 'long' ELSE tier END AS tier, CASE WHEN tier = 'permanent' THEN 0 WHEN tier = 'long' OR tier = 'short' AND hit_count >= 3 THEN epoch_us({_AT} + INTERVAL 1080 HOUR) ELSE epoch_us({_AT} + INTERVAL 240 HOUR) END AS expires_us FROM {_PAGES}")
def j8_next_expiry(spark: SparkSession, root: str) -> DataFrame:
    """Tier and expiry that every page would get by a hit now."""
    rows = records(spark, root, "scrape_cache", "tier", "hit_count")
    tier = tiers.promoted(F.col("tier"), F.col("hit_count"), SETTINGS.tiers)
    return rows.select("id", tier.alias("tier"), F.coalesce(F.unix_micros(tiers.expiry(F.lit(NOW), tier, SETTINGS.tiers)), F.lit(0)).alias("expires_us"))


@query(
    f"""SELECT v.owner_kind, v.id, v.model FROM (SELECT DISTINCT owner_kind, id, model FROM vectors) v
WHERE NOT EXISTS (SELECT 1 FROM {_FACTS} f WHERE v.owner_kind = 'memory' AND f.id = v.id AND f.expires_at < {_AT}) AND NOT EXISTS (SELECT 1 FROM {_CACHE} c WHERE v.owner_kind = 'search' AND c.id = v.id AND c.expires_at < {_AT})"""
)
def j9_vectors_after_cleanup(spark: SparkSession, root: str) -> DataFrame:
    """Vectors that are left once expired facts and cached queries went."""
    gone = {kind: lifecycle.expired(records(spark, root, table, "expires_at"), NOW) for kind, table in (("memory", "memory_facts"), ("search", "search_cache"))}
    return lifecycle.cascade(records(spark, root, "vectors"), gone).select("owner_kind", "id", "model")


@query(
    f"""SELECT id, raw_html IS NOT NULL AND NOT dropped AS has_raw, clean_html IS NOT NULL AND NOT dropped AS has_clean FROM (SELECT *, created_at < {_AT} - INTERVAL 48 HOUR AND row_number() OVER (ORDER BY created_at DESC, id DESC) > 10 AS dropped FROM {_PAGES})"""
)
def j10_trimmed_pages(spark: SparkSession, root: str) -> DataFrame:
    """Which pages keep their HTML: the young ones and the 10 newest."""
    here = lambda c: F.when(F.col(c).isNotNull(), F.lit("")).alias(c)  # noqa: E731 - whether it is there, not the body
    rows = records(spark, root, "scrape_cache", "created_at", here("raw_html"), here("clean_html"))
    kept = lifecycle.trimmed(rows, NOW, SETTINGS.retention.raw_max_age, SETTINGS.retention.raw_keep_last)
    return kept.select("id", F.col("raw_html").isNotNull().alias("has_raw"), F.col("clean_html").isNotNull().alias("has_clean"))


@query(
    f"""WITH fetched AS (SELECT url, min(id) AS uid FROM {_URLS} GROUP BY url), cache AS {_PAGES},
minted AS (SELECT url, printf('%012x', epoch_ms({_AT})) AS t, sha256(url) AS h FROM fetched)
SELECT coalesce(c.url, f.url) AS url, coalesce(c.id, substr(t, 1, 8) || '-' || substr(t, 9, 4) || '-7' || substr(h, 1, 3) || '-8' || substr(h, 4, 3) || '-' || substr(h, 7, 12)) AS id, CASE WHEN f.url IS NULL THEN c.tier ELSE 'short' END AS tier, CASE WHEN f.url IS NULL THEN c.hit_count ELSE 0 END AS hit_count,
CASE WHEN f.url IS NULL THEN c.content_hash WHEN length(f.url) % 3 = 0 THEN NULL ELSE sha256('page of ' || f.url) END AS content_hash, CASE WHEN f.url IS NULL THEN c.error WHEN length(f.url) % 3 = 0 THEN 'timeout' END AS error, epoch_us(CASE WHEN f.url IS NULL THEN c.fetched_at ELSE {_AT} END) AS fetched_us
FROM cache c FULL JOIN fetched f ON f.url = c.url LEFT JOIN minted ON minted.url = f.url"""
)
def j6_saved_pages(spark: SparkSession, root: str) -> DataFrame:
    """The page cache after every registered address was fetched again, a third of them in vain."""
    known = records(spark, root, "urls", "url").select("url").distinct()
    failed = F.length("url") % 3 == 0
    fetched = known.select("url", F.when(~failed, F.concat(F.lit("page of "), "url")).alias("text_content"), F.when(failed, "timeout").alias("error"))
    cache = records(spark, root, "scrape_cache", "url", "tier", "hit_count", "content_hash", "error", "expires_at", "fetched_at", "created_at").withColumn("updated_at", F.col("fetched_at"))
    saved = lifecycle.saved_pages(cache, fetched, NOW, SETTINGS.tiers)
    return saved.select("url", "id", "tier", "hit_count", "content_hash", "error", micros("fetched_at").alias("fetched_us"))


@query(
    f"""SELECT id, mode, epoch_us(started_at) AS started_us, CASE WHEN finished_at IS NULL THEN epoch_us({_AT}) ELSE epoch_us(finished_at) END AS finished_us FROM {_RUNS}
UNION ALL SELECT 'again:' || id, mode, epoch_us({_AT}), NULL FROM {_RUNS} WHERE finished_at IS NULL"""
)
def j12_runs(spark: SparkSession, root: str) -> DataFrame:
    """All runs after those that were open are finished and each of these is started again."""
    known = records(spark, root, "runs", "mode", "artifact_dir", "started_at", "finished_at", "created_at")
    open_ = known.where("finished_at is null")
    again = open_.select(F.concat(F.lit("again:"), "id").alias("id"), "mode", "artifact_dir")
    done = lifecycle.started_runs(lifecycle.finished_runs(known, open_, NOW), again, NOW)
    return done.select("id", "mode", micros("started_at").alias("started_us"), micros("finished_at").alias("finished_us"))


@query(
    f"""WITH facts AS {_FACTS}, known AS {_VECTORS}, asked AS (SELECT id, v FROM known WHERE owner_kind = 'memory' AND CAST('0x' || right(id, 8) AS BIGINT) % 50 = 0),
near AS (SELECT a.id AS new_id, arg_min(k.id, (round(1 - list_cosine_similarity(a.v, k.v), 5), k.id)) AS fact_id FROM asked a JOIN known k ON k.owner_kind = 'memory' AND k.id <> a.id GROUP BY a.id, a.v),
hit AS (SELECT n.new_id, n.fact_id FROM near n JOIN asked a ON a.id = n.new_id JOIN known k ON k.owner_kind = 'memory' AND k.id = n.fact_id WHERE round(1 - (round(1 - list_cosine_similarity(a.v, k.v), 5) + 0.0), 5) >= 0.95 AND n.fact_id IN (SELECT id FROM facts) AND n.new_id IN (SELECT id FROM facts)),
over AS (SELECT fact_id, max(new_id) AS new_id FROM hit GROUP BY fact_id)
SELECT f.id, CASE WHEN o.new_id IS NULL THEN f.text ELSE 'again: ' || g.text END AS text, f.hit_count FROM facts f LEFT JOIN over o ON o.fact_id = f.id LEFT JOIN facts g ON g.id = o.new_id
UNION ALL SELECT 'new:' || f.id, 'again: ' || f.text, 0 FROM facts f JOIN asked a ON a.id = f.id WHERE f.id NOT IN (SELECT new_id FROM hit)"""
)
def j4_stored_facts(spark: SparkSession, root: str) -> DataFrame:
    """The facts after those of the query set are told again: each overwrites the most similar other fact, or is added."""
    known = vectors.current(read_table(spark, root, "vectors", ["id", "owner_kind", "embedding", "model", "created_at"])).where("owner_kind = 'memory'")
    asked = known.where(vectors.id_number() % 50 == 0)
    near = vectors.search(known, asked.select("id", "embedding"), 2).where("query_id <> id")  # the fact itself is among the two
    first = near.groupBy("query_id").agg(F.min(F.struct("distance", "id", "owner_kind")).alias("m")).select("query_id", "m.*", F.lit(1).alias("position"))
    matches = lifecycle.matched_facts(first, 0.95)
    facts = records(spark, root, "memory_facts", "text", "source_url", "volatility", "tier", "hit_count", "expires_at", "fetched_at", "created_at").withColumn("updated_at", F.col("fetched_at"))
    told = facts.join(asked.select("id"), "id", "left_semi").select("id", F.concat(F.lit("again: "), "text").alias("text"), "source_url", "volatility", "tier")
    stored = lifecycle.stored_facts(facts, told, matches.join(facts.select(F.col("id").alias("fact_id")), "fact_id", "left_semi"), NOW, SETTINGS.tiers)
    return stored.select(F.when(F.col("created_at") == F.lit(NOW), F.concat(F.lit("new:"), "id")).otherwise(F.col("id")).alias("id"), "text", "hit_count")


@query(
    f"""SELECT u.url, CASE WHEN p.url IS NULL THEN 'http' WHEN p.until >= {_AT} THEN 'cache' WHEN p.status = 304 THEN 'cache-revalidated' ELSE 'http' END AS outcome
FROM (SELECT DISTINCT url FROM {_URLS}) u LEFT JOIN (SELECT url, max(coalesce(expires_at, TIMESTAMPTZ '9999-12-31 00:00:00+00')) AS until, min(CASE WHEN etag IS NOT NULL THEN 304 ELSE 200 END) AS status FROM {_PAGES} GROUP BY url) p USING (url)"""
)
def j14_refresh(spark: SparkSession, root: str) -> DataFrame:
    """What a scrape of every registered address would do, if servers confirm what has an ETag."""
    pages = records(spark, root, "scrape_cache", "url", "expires_at", "etag")
    answers = pages.select("url", F.when(F.col("etag").isNotNull(), 304).otherwise(200).alias("status"))
    return lifecycle.refreshed(records(spark, root, "urls", "url"), pages, answers, NOW)


# ---- functions


@query(f"SELECT trim(regexp_replace(lower(term), '\\s+', ' ', 'g')) AS term, count(*) AS searches FROM {_SEARCHES} GROUP BY 1")
def k1_distinct_terms(spark: SparkSession, root: str) -> DataFrame:
    """Terms up to case and spacing."""
    return runs.distinct_terms(spark, root)


@query(f"SELECT id, CASE WHEN coalesce(text_content, '') <> '' THEN sha256(text_content) WHEN coalesce(clean_html, '') <> '' THEN sha256(clean_html) ELSE '' END AS hash FROM {_PAGES}")
def k3_content_hash(spark: SparkSession, root: str) -> DataFrame:
    """Hash of the content of every page."""
    return records(spark, root, "scrape_cache", text.content_hash(F.col("text_content"), F.col("clean_html")).alias("hash"))


@query(f"SELECT hash, count(*) AS pages, min(id) AS id FROM (SELECT id, sha256(text_content) AS hash FROM {_PAGES} WHERE coalesce(text_content, '') <> '') GROUP BY hash HAVING count(*) > 1")
def k3_equal_pages(spark: SparkSession, root: str) -> DataFrame:
    """Groups of pages with the same text."""
    hashes = records(spark, root, "scrape_cache", F.when(F.col("text_content") != "", F.sha2("text_content", 256)).alias("hash")).where("hash is not null")
    return hashes.groupBy("hash").agg(F.count("*").alias("pages"), F.min("id").alias("id")).where("pages > 1")


@query(f"SELECT id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, url LIKE 'http%' AS is_url FROM {_URLS}")
def k4_domains(spark: SparkSession, root: str) -> DataFrame:
    """Host of every registered address."""
    return records(spark, root, "urls", "url").select("id", urls.domain_of(F.col("url")).alias("host"), urls.looks_like_url(F.col("url")).alias("is_url"))


@query(f"SELECT id, url FROM {_URLS}")
def k7_unwrapped(spark: SparkSession, root: str) -> DataFrame:
    """Every address behind two click wrappers, one of them in base64, and unwrapped again."""
    rows = records(spark, root, "urls", "url")
    coded = F.translate(F.regexp_replace(F.base64(F.encode("url", "UTF-8")), "[=\r\n]", ""), "+/", "-_")
    inner = F.concat(F.lit("https://engine.invalid/ck/a?u=a1"), coded)
    outer = F.concat(F.lit("https://other.invalid/l/?uddg="), F.url_encode(inner))
    return rows.select("id", urls.unwrap(outer).alias("url"))


@query(
    f"""WITH parts AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) || regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS hp, regexp_extract(url, '\\?([^#]*)', 1) AS qs FROM {_URLS})
SELECT regexp_replace(hp, '/$', '') || '?' || qs AS key, count(*) AS variants, arg_min(url, (first_seen_at, id)) AS url FROM parts GROUP BY 1"""
)
def k10_canonical_urls(spark: SparkSession, root: str) -> DataFrame:
    """Addresses that differ in scheme, port, fragment or a slash at the end, as one; the first seen is kept."""
    rows = records(spark, root, "urls", "url", "first_seen_at")
    return rows.groupBy(urls.dedupe_key(F.col("url")).alias("key")).agg(F.count("*").alias("variants"), F.min(F.struct("first_seen_at", "id", "url")).alias("m")).select("key", "variants", "m.url")


@query(
    f"""WITH r AS (SELECT id, unnest(range(1, len(results) + 1)) AS p, results FROM {_CACHE}), u AS (SELECT id, p, results[p].url AS url FROM r),
parts AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS qs FROM u)
SELECT id, url, CAST(row_number() OVER (PARTITION BY id ORDER BY p) AS INT) AS position FROM (SELECT * FROM parts WHERE host <> '' QUALIFY row_number() OVER (PARTITION BY id, regexp_replace(host || path, '/$', '') || '?' || qs ORDER BY p) = 1)"""
)
def k6_destinations(spark: SparkSession, root: str) -> DataFrame:
    """Stored results as raw links of a result page: unwrapped, without engine hosts, without variants, in order."""
    links = records(spark, root, "search_cache", "results").select("id", F.transform("results", lambda r: r["url"]).alias("links"))
    return urls.destinations(links, "google")


@query(
    f"""SELECT id, contains(lower(coalesce(landed_url, '')), '/sorry/') OR contains(lower(coalesce(landed_url, '')), 'captcha') AS challenged, blocked FROM {_SEARCHES}"""
)
def k13_challenged(spark: SparkSession, root: str) -> DataFrame:
    """Searches that landed on a challenge, beside what was recorded."""
    rows = records(spark, root, "searches", "landed_url", "blocked")
    return rows.select("id", text.looks_blocked(F.col("landed_url"), F.lit(None).cast("string")).alias("challenged"), "blocked")


@query(
    f"""SELECT id, {" OR ".join(f"contains(lower(left(coalesce(text_content, ''), {text.BLOCK_SCAN_CHARS})), '{hint.replace("'", "''")}')" for hint in text.BLOCK_HINTS)} OR contains(lower(url), '/sorry/') OR contains(lower(url), 'captcha') AS challenged FROM {_PAGES}"""
)
def k13_challenged_pages(spark: SparkSession, root: str) -> DataFrame:
    """Cached pages that are a challenge, by their address or by a hint in their text."""
    return records(spark, root, "scrape_cache", text.looks_blocked(F.col("url"), F.col("text_content")).alias("challenged"))


@query(
    f"""SELECT id, strlen(coalesce(text_content, '')) < 500 OR regexp_matches(coalesce(raw_html, ''), '(?i)<div[^>]+id=["''](root|app|__next)["''][^>]*>\\s*</div>') AS render FROM {_PAGES}"""
)
def k25_pages_to_render(spark: SparkSession, root: str) -> DataFrame:
    """Pages that a browser should fetch again: of little text, or with the mount of a script application."""
    return records(spark, root, "scrape_cache", text.needs_render(F.col("text_content"), F.col("raw_html"), SETTINGS.scrape.min_text_chars).alias("render"))


@query(
    f"SELECT id, url_decode(replace(regexp_extract(coalesce(landed_url, ''), '[?&]q=([^&#]*)', 1), '+', ' ')) AS landed, trim(regexp_replace(lower(url_decode(replace(regexp_extract(coalesce(landed_url, ''), '[?&]q=([^&#]*)', 1), '+', ' '))), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(term), '\\s+', ' ', 'g')) AS same FROM {_SEARCHES}"
)
def k14_landed_queries(spark: SparkSession, root: str) -> DataFrame:
    """The query in the address that each search landed on, and whether it is the one asked for."""
    rows = records(spark, root, "searches", "landed_url", "term")
    landed = urls.landed_query(F.col("landed_url"))
    return rows.select("id", landed.alias("landed"), text.same_query(landed, F.col("term")).alias("same"))


@query(
    f"""SELECT id, CASE engine WHEN 'google' THEN 'https://www.google.com/search?q=' || t || '&num=20' WHEN 'bing' THEN 'https://www.bing.com/search?q=' || t || '&count=20' WHEN 'duckduckgo' THEN 'https://duckduckgo.com/?q=' || t END AS search_url
FROM (SELECT id, engine, replace(url_encode(term), '%20', '+') AS t FROM {_SEARCHES})"""
)
def k15_search_urls(spark: SparkSession, root: str) -> DataFrame:
    """Result page of every term on its engine, with 20 results asked for."""
    return records(spark, root, "searches", "engine", "term").select("id", urls.search_url(F.col("engine"), F.col("term"), 20).alias("search_url"))


@query()
def k17_cleaned_pages(spark: SparkSession, root: str) -> DataFrame:
    """Title, text and images of every page with raw HTML, cleaned again."""
    rows = current_rows(read_table(spark, root, "scrape_cache", ["id", "updated_at", "raw_html", "url"]), "id", "updated_at")
    done = html.cleaned(rows.select("id", "raw_html", "url"))  # the newest delivery alone is parsed
    return done.select("id", "title", "text", F.size("images").alias("images")).dropDuplicates(["id"])


@query(f"SELECT id, trim(regexp_extract(raw_html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM {_PAGES} WHERE raw_html IS NOT NULL")
def k18_titles(spark: SparkSession, root: str) -> DataFrame:
    """Title of every page by expression."""
    return records(spark, root, "scrape_cache", html.title_of(F.col("raw_html")).alias("title")).where("title is not null")


_BLANK = "[\\s\\x{000B}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


@query(
    f"""SELECT id, CAST(length(text_content) AS INT) AS before, CAST(length(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text_content, chr(10)), lambda x: trim(regexp_replace(x, '{_BLANK}', ' ', 'g'))), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS INT) AS after
FROM {_PAGES} WHERE text_content IS NOT NULL"""
)
def k22_collapsed_texts(spark: SparkSession, root: str) -> DataFrame:
    """Characters of every text before and after its white space is collapsed."""
    return records(spark, root, "scrape_cache", F.length("text_content").alias("before"), F.length(text.collapse_whitespace(F.col("text_content"))).alias("after")).where("before is not null")


@query(f"SELECT id, url AS resolved FROM {_PAGES}")
def k23_resolved(spark: SparkSession, root: str) -> DataFrame:
    """Every page's address as its own reference, without scheme and host, resolved again."""
    rows = records(spark, root, "scrape_cache", "url")
    return rows.select("id", urls.resolve_reference(F.col("url"), F.regexp_replace("url", "^[a-z]+://[^/]+", "")).alias("resolved"))


@query(f"SELECT id, trim(coalesce(content_type, '')) = '' OR lower(content_type) LIKE '%text/html%' OR lower(content_type) LIKE '%xhtml%' AS html, coalesce(strlen(text_content), 0) < 500 AS thin FROM {_PAGES}")
def k25_thin_pages(spark: SparkSession, root: str) -> DataFrame:
    """Which pages are HTML, and which have so little text that a browser should fetch them."""
    thin = text.needs_render(F.col("text_content"), F.lit(None).cast("string"), SETTINGS.scrape.min_text_chars)
    return records(spark, root, "scrape_cache", text.is_html(F.col("content_type")).alias("html"), thin.alias("thin"))


@query(f"SELECT source_url, text, volatility FROM {_FACTS} WHERE source_url IS NOT NULL")
def k29_distilled_facts(spark: SparkSession, root: str) -> DataFrame:
    """Every fact written as a model's JSON answer, and read back from it."""
    rows = records(spark, root, "memory_facts", "text", "volatility", "source_url").where("source_url is not null")
    answer = F.concat(F.lit("Here they are: "), F.to_json(F.array(F.struct("text", "volatility"))), F.lit(" - done"))
    return rows.select("source_url", F.explode(text.extracted_facts(answer)).alias("f")).select("source_url", "f.text", "f.volatility")


_LIMIT = SETTINGS.scrape.distill_max_bytes


@query(
    f"""SELECT id, CAST(CASE WHEN strlen(text_content) <= {_LIMIT} THEN strlen(text_content) ELSE {_LIMIT} - CASE """
    + " ".join(f"WHEN substr(h, 2 * ({_LIMIT} - {i}) + 1, 2) NOT BETWEEN '80' AND 'BF' THEN {i}" for i in range(4))
    + f""" END END AS INT) AS bytes, true AS is_prefix FROM (SELECT id, text_content, hex(encode(text_content)) AS h FROM {_PAGES} WHERE text_content IS NOT NULL)"""
)
def k31_truncated_texts(spark: SparkSession, root: str) -> DataFrame:
    """Bytes of every text once it is cut for a distil call."""
    cut = text.truncate_bytes(F.col("text_content"), SETTINGS.scrape.distill_max_bytes)
    return records(spark, root, "scrape_cache", F.octet_length(cut).alias("bytes"), F.col("text_content").startswith(cut).alias("is_prefix")).where("bytes is not null")


@query("SELECT event_id AS id, CASE WHEN contains(m, 'ERROR') THEN 'error' WHEN contains(m, 'WARNING') THEN 'warn' WHEN contains(m, 'NOTE') THEN 'notice' ELSE 'info' END AS level FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ERROR: ' WHEN 1 THEN 'WARNING: ' WHEN 2 THEN 'NOTE: ' ELSE '' END || props AS m FROM events)")
def k33_levels(spark: SparkSession, root: str) -> DataFrame:
    """Level of every log message by its marker."""
    marker = F.element_at(F.array(*[F.lit(m) for m in ("ERROR: ", "WARNING: ", "NOTE: ", "")]), (F.col("event_id") % 4).cast("int") + 1)
    return read_table(spark, root, "events", ["event_id", "props"]).select(F.col("event_id").alias("id"), text.level_of(F.concat(marker, "props")).alias("level"))


@query(f"SELECT id, CASE WHEN length(text) > 60 THEN left(text, 60) || '…' ELSE text END AS preview, CASE WHEN length(text) > 40 THEN left(text, 20) || '…' || right(text, 19) ELSE text END AS short FROM {_FACTS}")
def k37_previews(spark: SparkSession, root: str) -> DataFrame:
    """Previews of facts: their beginning, and both of their ends."""
    return records(spark, root, "memory_facts", text.preview(F.col("text")).alias("preview"), text.middle_truncated(F.col("text")).alias("short"))


@query(f"SELECT id, url, coalesce(title, '') AS title, left(text_content, 2000) AS snippet, length(text_content) > 2000 AS truncated FROM {_PAGES} WHERE coalesce(text_content, '') <> '' AND error IS NULL")
def k41_snippets(spark: SparkSession, root: str) -> DataFrame:
    """Beginning of the text of every page that was fetched."""
    rows = records(spark, root, "scrape_cache", "url", "title", "error", F.left("text_content", F.lit(SETTINGS.scrape.snippet_chars)).alias("snippet"), (F.length("text_content") > SETTINGS.scrape.snippet_chars).alias("truncated"))
    return rows.where("snippet <> '' and error is null").select("id", "url", F.coalesce("title", F.lit("")).alias("title"), "snippet", "truncated")


# ---- queue and logs


@query(f"SELECT id, type FROM {_JOBS} WHERE status = 'pending' AND run_after <= {_EVENT_AT} ORDER BY run_after, id LIMIT 128")
def l2_claimable(spark: SparkSession, root: str) -> DataFrame:
    """The jobs that are taken next."""
    return jobs.claimable(lens.jobs(spark, root), EVENT_NOW, 128).select("id", "type")


@query(
    f"""SELECT id, CASE WHEN status <> 'running' THEN status WHEN attempts + 1 < 5 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN status = 'running' AND attempts + 1 < 5 THEN attempts + 1 ELSE attempts END AS attempts,
epoch_us(CASE WHEN status = 'running' AND attempts + 1 < 5 THEN {_EVENT_AT} + to_seconds((attempts + 1) * (attempts + 1)) ELSE run_after END) AS run_after_us FROM {_JOBS}"""
)
def l3_settled(spark: SparkSession, root: str) -> DataFrame:
    """The queue after every running job failed: retries with growing pauses, then failure."""
    queue = lens.jobs(spark, root)
    failed = queue.where("status = 'running'").select("id", F.lit(False).alias("ok"))
    return jobs.settled(queue, failed, EVENT_NOW).select("id", "status", "attempts", micros("run_after").alias("run_after_us"))


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'running' AND locked_at < {_EVENT_AT} - INTERVAL 30 MINUTE THEN 'pending' ELSE status END AS status FROM {_JOBS}) GROUP BY status UNION ALL SELECT 'running', 0 WHERE NOT EXISTS (SELECT 1 FROM {_JOBS} WHERE status = 'running' AND NOT locked_at < {_EVENT_AT} - INTERVAL 30 MINUTE)")
def l4_reaped(spark: SparkSession, root: str) -> DataFrame:
    """Queue by status after stale jobs were taken back."""
    return jobs.status_counts(jobs.reaped(lens.jobs(spark, root), EVENT_NOW))


@query(f"SELECT type, status, count(*) AS n FROM {_JOBS} GROUP BY ALL")
def l7_job_counts(spark: SparkSession, root: str) -> DataFrame:
    """Jobs by type and status."""
    return lens.jobs(spark, root).groupBy("type", "status").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) FILTER (attempts > 1) AS retried, CAST(max(attempts) AS BIGINT) AS max_attempts, min(CASE WHEN status = 'pending' THEN epoch_us(created_at) END) AS oldest_pending_us FROM {_JOBS}")
def e7_job_summary(spark: SparkSession, root: str) -> DataFrame:
    """Retries and backlog of the queue."""
    return jobs.summary(lens.jobs(spark, root))


@query(
    f"""WITH last AS (SELECT * FROM {_JOBS} WHERE status = 'done' ORDER BY updated_at DESC, id DESC LIMIT 200)
SELECT count(*) AS sampled, CAST(floor(floor(sum(epoch_us(updated_at) - epoch_us(created_at)) / 1000) / count(*)) AS BIGINT) AS avg_ms FROM last WHERE updated_at >= created_at"""
)
def e11_job_timing(spark: SparkSession, root: str) -> DataFrame:
    """Mean run of the 200 jobs finished last."""
    return jobs.timing(lens.jobs(spark, root), SETTINGS.observability.job_timing_sample)


@query(f"SELECT id, level, source, message, epoch_us(created_at) AS created_us FROM {_LOGS} WHERE level = 'warn' ORDER BY created_at DESC, id DESC LIMIT 50")
def g2_logs_page(spark: SparkSession, root: str) -> DataFrame:
    """A page of warnings, newest first."""
    rows = lens.logs(spark, root).where(paging.equals("level", "warn"))
    return paging.page(rows, [F.col("created_at").desc(), F.col("id").desc()]).select("id", "level", "source", "message", micros("created_at").alias("created_us"))


def _drained(spark: SparkSession, root: str, name: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """All of the event stream through ``build``, written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    base = posixpath.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"{name}-{spark._jvm.java.util.UUID.randomUUID()}")
    source = log_stream.stream_of(spark, f"{root}/event[s].parquet")  # a pattern: the table may be one file
    lines = lens.log_rows(source)
    if mode == "complete":
        last: list[str] = []

        def keep(batch: DataFrame, number: int) -> None:
            last.append(posixpath.join(base, f"batch-{number}"))
            batch.write.parquet(last[-1])

        build(lines).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(last[-1])
    log_stream.drain(build(lines), f"{base}/out", f"{base}/state", mode)
    return spark.read.parquet(f"{base}/out")


@query(f"SELECT level, count(*) AS n FROM {_LOGS} GROUP BY level")
def l8_streamed_levels(spark: SparkSession, root: str) -> DataFrame:
    """Log lines by level, written by the streaming pipeline and counted afterwards."""
    return _drained(spark, root, "lines", lambda s: s, "append").groupBy("level").agg(F.count("*").alias("n"))


@query(f"SELECT epoch_us(time_bucket(INTERVAL '1 hour', created_at)) AS start_us, level, count(*) AS n FROM {_LOGS} GROUP BY ALL")
def l8_streamed_windows(spark: SparkSession, root: str) -> DataFrame:
    """Log lines by hour and level, counted in the stream."""
    return _drained(spark, root, "windows", log_stream.windowed_counts, "complete").select(micros("start").alias("start_us"), "level", "n")


# ---- provenance


@query(
    _LINKED
    + f""", found AS (SELECT url, count(*) AS found_by, min(rank) AS best_rank FROM linked GROUP BY url),
facts AS (SELECT source_url AS url, count(*) AS facts, count(*) FILTER (EXISTS (SELECT 1 FROM vectors v WHERE v.owner_kind = 'memory' AND v.id = f.id)) AS facts_with_vector FROM {_FACTS} f WHERE source_url IS NOT NULL GROUP BY source_url),
u AS (SELECT url, min(id) AS url_id FROM {_URLS} GROUP BY url), p AS (SELECT url, min(id) AS scrape_id FROM {_PAGES} GROUP BY url)
SELECT coalesce(u.url, p.url, facts.url) AS url, url_id, scrape_id, coalesce(found_by, 0) AS found_by, coalesce(best_rank, 0) AS best_rank, coalesce(facts, 0) AS facts, coalesce(facts_with_vector, 0) AS facts_with_vector, url_id IS NOT NULL OR scrape_id IS NOT NULL AS known
FROM u FULL JOIN p ON p.url = u.url LEFT JOIN found ON found.url = coalesce(u.url, p.url) FULL JOIN facts ON facts.url = coalesce(u.url, p.url)"""
)
def m1_url_provenance(spark: SparkSession, root: str) -> DataFrame:
    """What led to every address and what came of it."""
    return provenance.url_provenance(spark, root)


_GRAPH = (
    _LINKED
    + f""", capped AS (SELECT * FROM linked QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY rank, url, search_id) <= 200),
run_urls AS (SELECT DISTINCT run_id, url_id, url FROM capped),
scrapes AS (SELECT r.run_id, r.url_id, p.id, p.url, p.title, p.http_status FROM run_urls r JOIN {_PAGES} p ON p.url = r.url),
facts AS (SELECT r.run_id, r.url_id, f.id, f.text, f.volatility, EXISTS (SELECT 1 FROM vectors v WHERE v.owner_kind = 'memory' AND v.id = f.id) AS has_vector FROM run_urls r JOIN {_FACTS} f ON f.source_url = r.url)
"""
)


_EDGES = """SELECT run_id, 'search:' || search_id AS source, 'url:' || url_id AS target, rank FROM capped UNION ALL SELECT run_id, 'url:' || url_id, 'scrape:' || id, 0 FROM scrapes UNION ALL SELECT run_id, 'url:' || url_id, 'fact:' || id, 0 FROM facts"""
_NODES = f"""SELECT run_id, 'search:' || id AS id, 'search' AS kind, id AS ref_id, engine || ' · ' || term AS label, search_mode AS detail, false AS has_vector FROM {_SEARCHES}
UNION ALL SELECT run_id, 'url:' || url_id, 'url', url_id, url, '', false FROM run_urls
UNION ALL SELECT DISTINCT run_id, 'scrape:' || id, 'scrape', id, coalesce(nullif(title, ''), url), 'HTTP ' || coalesce(http_status, 0), false FROM scrapes
UNION ALL SELECT DISTINCT run_id, 'fact:' || id, 'fact', id, text, coalesce(volatility, ''), has_vector FROM facts"""


@query(_GRAPH + _EDGES)
def m2_causality_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges of the causality graph of every run."""
    return provenance.causality(spark, root)[1]


@query(_LINKED + "SELECT run_id, least(count(*), 200) AS links, count(*) > 200 AS truncated FROM linked GROUP BY run_id")
def g7_truncated_graphs(spark: SparkSession, root: str) -> DataFrame:
    """How many links the graph of each run shows, and whether there are more."""
    return provenance.causality(spark, root).cut


@query(f"WITH known AS {_VECTORS}, n AS (SELECT count(*) AS total FROM known) SELECT owner_kind, id, total, least(total, 300) < total AS truncated FROM (SELECT owner_kind, id FROM known ORDER BY owner_kind, id LIMIT 200 OFFSET 100), n")
def g8_projection_page(spark: SparkSession, root: str) -> DataFrame:
    """The second page of the projection's sample, with the total and whether more follow."""
    known = vectors.current(read_table(spark, root, "vectors", ["id", "owner_kind", "embedding", "model", "created_at"]))
    return vectors.sample_page(known, 200, 100)


@query(_GRAPH + _NODES)
def m2_causality_nodes(spark: SparkSession, root: str) -> DataFrame:
    """Nodes of the causality graph of every run."""
    return provenance.causality(spark, root)[0]


@query(_GRAPH + f"SELECT k.kind, count(n.kind) AS n FROM (VALUES ('search'), ('url'), ('scrape'), ('fact')) k(kind) LEFT JOIN ({_NODES}) n ON n.kind = k.kind GROUP BY k.kind")
def e12_node_counts(spark: SparkSession, root: str) -> DataFrame:
    """Nodes of all graphs by kind."""
    return provenance.node_counts(provenance.causality(spark, root)[0])


@query(_GRAPH + f", edges AS ({_EDGES}) SELECT a.run_id, a.source AS search, a.target || coalesce('/' || b.target, '') AS path FROM edges a LEFT JOIN edges b ON b.run_id = a.run_id AND b.source = a.target WHERE a.source LIKE 'search:%'")
def m3_trees(spark: SparkSession, root: str) -> DataFrame:
    """The graphs as trees below their searches."""
    return provenance.tree(*provenance.causality(spark, root)[:2])


@query(_LINKED + "SELECT run_id, key, arg_min(url, (term, rank, url)) AS url FROM (SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) || regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/$', '') || '?' || regexp_extract(url, '\\?([^#]*)', 1) AS key FROM linked) GROUP BY run_id, key")
def e14_deduped_results(spark: SparkSession, root: str) -> DataFrame:
    """Results of a run without variants of the same address."""
    return runs.deduped_run_results(spark, root)


@query(f"SELECT user_id, event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def k30_payload_fields(spark: SparkSession, root: str) -> DataFrame:
    """A field of the JSON payloads, summed."""
    e = read_table(spark, root, "events", ["user_id", "event_type", "props"])
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total"))
