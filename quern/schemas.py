"""Schemas of the tables, as DDL."""

from __future__ import annotations

from pyspark.sql.types import StructType

DDL = {
    "runs": "id string, mode string, artifact_dir string, started_at timestamp, finished_at timestamp, created_at timestamp",
    "searches": "id string, run_id string, term string, engine string, search_mode string, requested_url string, landed_url string, http_status int, blocked boolean, anchor_count int, error string, duration_ms bigint, created_at timestamp",
    "search_raw": "id string, search_id string, html string, byte_size bigint, created_at timestamp",
    "urls": "id string, url string, domain string, first_seen_at timestamp, created_at timestamp",
    "search_urls": "id string, search_id string, url_id string, rank int, created_at timestamp",
    "scrape_cache": "id string, url string, run_id string, http_status int, content_type string, fetched_with string, robots_allowed boolean, title string, raw_html string, clean_html string, text_content string, images array<struct<url: string, alt: string, width: int, height: int>>, content_hash string, etag string, last_modified string, error string, tier string, hit_count int, expires_at timestamp, fetched_at timestamp, duration_ms bigint, created_at timestamp, updated_at timestamp",
    "memory_facts": "id string, text string, source_url string, volatility string, tier string, hit_count int, expires_at timestamp, fetched_at timestamp, created_at timestamp, updated_at timestamp",
    "search_cache": "id string, query_norm string, query string, results array<struct<url: string, domain: string, rank: int>>, tier string, hit_count int, expires_at timestamp, fetched_at timestamp, created_at timestamp, updated_at timestamp",
    "vectors": "id string, owner_kind string, embedding array<float>, model string, dim int, created_at timestamp",
    "jobs": "id string, type string, payload string, status string, attempts int, run_after timestamp, locked_at timestamp, created_at timestamp, updated_at timestamp",
    "logs": "id string, run_id string, level string, source string, message string, created_at timestamp",
    "system_meta": "key string, value string, updated_at timestamp",
}


def schema(table: str) -> StructType:
    """Schema of a table by name."""
    return StructType.fromDDL(DDL[table])
