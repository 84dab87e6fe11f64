"""One object for all reads: a method for each question that can be asked of a store."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import Settings
from quern.functions.options import clamp_k, clamp_projection, required
from quern.operators import lifecycle, paging, provenance, runs, stats, vectors
from quern.operators.records import records
from quern.plans import resolver
from quern.runtime import read_table
from quern.schemas import schema
from quern.sources.models import ChatModel, Embedder, embedded


class Engine:
    """Reads over the tables in one folder; models are injected, nothing is fetched."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), embedder: Embedder | None = None, chat: ChatModel | None = None, now: datetime | None = None, vectors_state: str = "ready"):
        self.spark, self.root, self.settings, self.embedder, self.chat = spark, root, settings, embedder, chat
        self.now, self.vectors_state = now or datetime.now(timezone.utc), vectors_state

    def _records(self, table: str, *columns: str) -> DataFrame:
        return records(self.spark, self.root, table, *columns)

    def known_vectors(self) -> DataFrame:
        raw = read_table(self.spark, self.root, "vectors", ["id", "owner_kind", "embedding", "model", "created_at"])
        return vectors.current(raw, *((self.embedder.model, self.embedder.dim) if self.embedder else ()))

    def runs(self) -> DataFrame:
        return runs.list_runs(self.spark, self.root)

    def run(self, run_id: str) -> DataFrame:
        """One run; the filter reaches the scans of all that it is joined with."""
        return runs.list_runs(self.spark, self.root, run_id)

    def run_urls(self, run_id: str) -> DataFrame:
        return runs.run_urls(self.spark, self.root, run_id).orderBy("best_rank", "url")

    def run_searches(self, run_id: str) -> DataFrame:
        columns = ("run_id", "term", "engine", "search_mode", "landed_url", "http_status", "blocked", "anchor_count", "created_at")
        return records(self.spark, self.root, "searches", *columns, where=F.col("run_id") == run_id).orderBy("created_at", "id")

    def run_scrapes(self, run_id: str) -> DataFrame:
        return paging.cached_pages(self.spark, self.root, run_id=run_id)

    def run_causality(self, run_id: str, most: int | None = None) -> provenance.Graph:
        """Nodes, edges and whether links were left out."""
        return provenance.causality(self.spark, self.root, most or self.settings.observability.causality_max_urls, run_id)

    def scrape(self, scrape_id: str) -> DataFrame:
        rows = read_table(self.spark, self.root, "scrape_cache").where(F.col("id") == scrape_id)
        return rows.orderBy(F.col("updated_at").desc()).limit(1)

    def url_provenance(self, url: str) -> DataFrame:
        required(url=url)
        return provenance.url_provenance(self.spark, self.root, url)

    def searches_finding(self, url: str) -> DataFrame:
        required(url=url)
        return runs.searches_finding_url(self.spark, self.root, url).orderBy("rank", "search_id")

    def facts(self, q: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
        return paging.facts_page(self.spark, self.root, q, limit, offset)

    def fact(self, fact_id: str) -> DataFrame:
        required(id=fact_id)
        return provenance.fact_sources(self.spark, self.root).where(F.col("id") == fact_id)

    def cached_searches(self, tier: str | None = None, q: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
        return paging.cached_searches_page(self.spark, self.root, tier, q, limit, offset)

    def cached_pages(self, tier: str | None = None, q: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
        return paging.cached_pages_page(self.spark, self.root, tier, q, limit, offset)

    def stats(self) -> DataFrame:
        return stats.snapshot(self.spark, self.root, self.now)

    def explore(self, text: str, k: int | None = None) -> tuple[DataFrame, str]:
        """Nearest of both kinds and a note; the model is only asked when there are vectors to search."""
        required(q=text)
        k, note = clamp_k(k), {"none": "no vectors have been stored yet", "migrating": "vectors are being rebuilt"}.get(self.vectors_state, "")
        if note or self.embedder is None:
            return self.spark.createDataFrame([], "query_id string, place int, owner_kind string, id string, distance double, label string"), note or "no model to embed the text with"
        asked = self.spark.createDataFrame([("q", self.embedder.embed([text], as_query=True)[0])], "id string, embedding array<float>")
        owners = vectors.owners(self._records("memory_facts", "text", "source_url"), self._records("search_cache", "query"))
        return vectors.explore(vectors.search(self.known_vectors(), asked, k), owners, k), ""

    def projection(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Points of a bounded page of vectors, with the total and whether more follow."""
        known = self.known_vectors()
        page = vectors.sample_page(known, clamp_projection(limit, self.settings.observability.projection_sample_cap), offset)
        placed = vectors.scaled_to_box(vectors.project(known.join(page.select("owner_kind", "id"), ["owner_kind", "id"]), self.embedder.dim if self.embedder else 128))
        return placed.join(page, ["owner_kind", "id"])

    def saved_pages(self, fetched: DataFrame) -> DataFrame:
        """The page cache after fetches (url and what was fetched)."""
        columns = [c for c in schema("scrape_cache").names if c != "id"]
        return lifecycle.saved_pages(self._records("scrape_cache", *columns), fetched, self.now, self.settings.tiers)

    def stored_answers(self, answers: DataFrame) -> DataFrame:
        """The query cache after new answers (query_norm, query, results, tier)."""
        columns = [c for c in schema("search_cache").names if c != "id"]
        return lifecycle.stored_searches(self._records("search_cache", *columns), answers, self.now, self.settings.tiers)

    def kept_vectors(self) -> DataFrame:
        """Vectors that are left once expired facts and cached queries go."""
        gone = {kind: lifecycle.expired(self._records(table, "expires_at"), self.now) for kind, table in (("memory", "memory_facts"), ("search", "search_cache"))}
        return lifecycle.cascade(self._records("vectors", "embedding", "dim", "created_at"), gone)

    def answer(self, questions: DataFrame) -> DataFrame:
        """How each question (id, term) is answered: memory, cache or live."""
        facts = self._records("memory_facts", "text", "volatility", "expires_at", "fetched_at")
        cache = self._records("search_cache", "query_norm", "expires_at", "fetched_at")
        usable = self.embedder if self.vectors_state == "ready" else None
        planned = resolver.plan(questions, facts, cache, self.known_vectors(), usable, self.now, self.settings)
        if self.chat is not None and self.settings.memory.gate3_enabled:
            return resolver.adjudicated(planned, questions, self.chat)
        return planned.select("id", "source", F.col("facts").alias("answer"))

    def reembedded(self) -> DataFrame:
        """A new generation of vectors for all owners, to be committed as one snapshot before the old one goes."""
        facts = embedded(self._records("memory_facts", "text"), self.embedder, "memory")
        return facts.unionByName(embedded(self._records("search_cache", "query"), self.embedder, "search", "query"))
