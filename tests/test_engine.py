"""The facade and the chain from memory over the cache to live."""

from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quern.config import Memory, Settings
from quern.functions import urls
from quern.functions.html import result_links
from quern.operators import vectors
from quern.plans import resolver
from quern.plans.engine import Engine
from quern.schemas import schema
from quern.sources.models import ExtractiveChat, StubEmbedder, embedded

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
FACT = "The fixture page says Fixture One."


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """A small store: one run, two searches, two addresses, three pages, one fact, two cached queries."""
    base = str(tmp_path_factory.mktemp("seed"))
    one, two = "https://example.com/fixture-one", "https://example.org/fixture-two"
    tables = {
        "runs": [("01", "testserve", None, NOW, NOW, NOW)],
        "searches": [("02", "01", "fixture term", "google", "typed", None, "https://e.invalid/search?q=fixture", 200, False, 2, None, 42, NOW), ("0c", "01", "fixture term", "bing", "direct", None, None, 429, True, 0, "challenged", 91, NOW)],
        "urls": [("03", one, "example.com", NOW, NOW), ("04", two, "example.org", NOW, NOW)],
        "search_urls": [("06", "02", "03", 1, NOW), ("07", "02", "04", 2, NOW), ("08", "0c", "03", 5, NOW), ("08", "0c", "03", 5, NOW)],
        "scrape_cache": [(i, u, "01", s, "text/html", "http", True, t, None, None, x, None, None, None, None, None, tier, h, None, NOW, None, NOW, NOW) for i, u, s, t, x, tier, h in (("08", one, 200, "Fixture One", "Fixture One", "short", 3), ("0d", two, 404, None, None, "short", 0), ("12", "https://example.net/a", 200, "A", "A", "long", 5))],
        "memory_facts": [("09", FACT, one, "stable", "short", 0, None, NOW, NOW, NOW)],
        "search_cache": [("0a", "fixture term", "fixture term", [(one, "example.com", 1)], "short", 0, None, NOW, NOW, NOW), ("11", "fixture archive", "Fixture Archive", None, "long", 7, NOW, NOW, NOW, NOW)],
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, schema(name)).write.parquet(f"{base}/{name}.parquet")
    stub = StubEmbedder()
    owners = spark.createDataFrame([("09", FACT)], "id string, text string")
    both = embedded(owners, stub, "memory").unionByName(embedded(spark.createDataFrame([("0a", "fixture term")], "id string, text string"), stub, "search"))
    both.withColumn("created_at", F.lit(NOW)).write.parquet(f"{base}/vectors.parquet")
    return base


@pytest.fixture(scope="module")
def engine(spark, root):
    return Engine(spark, root, embedder=StubEmbedder(), now=NOW)


def test_reads(engine):
    assert [tuple(r) for r in engine.runs().collect()] == [("01", "testserve", 2, 2, 3)] and engine.run("none").count() == 0
    assert [(r.url_id, r.best_rank) for r in engine.run_urls("01").collect()] == [("03", 1), ("04", 2)]
    assert [r.search_id for r in engine.searches_finding("https://example.com/fixture-one").collect()] == ["02", "0c"]
    assert engine.run_searches("01").count() == 2 and engine.run_scrapes("01").count() == 3 and engine.scrape("08").first().title == "Fixture One"
    p = engine.url_provenance("https://example.com/fixture-one").first()
    assert (p.found_by, p.best_rank, p.scrape_id, p.facts, p.facts_with_vector, p.known) == (2, 1, "08", 1, 1, True)
    assert engine.url_provenance("https://unknown.example/").count() == 0 and engine.fact("09").first().text_chars == 11
    assert engine.facts(q="FIXTURE").count() == 1 and engine.cached_pages(q="example.org").count() == 1 and engine.cached_searches(tier="long").count() == 1 and engine.cached_searches(q=" Fixture  TERM ").count() == 1
    metrics = {r.metric: r.value for r in engine.stats().collect()}
    assert metrics["scrape_cache.tier.short"] == 2 and metrics["scrape_cache.tier.permanent"] == 0 and metrics["scrape_cache.total_hits"] == 8 and metrics["vectors"] == 2
    with pytest.raises(ValueError):
        engine.fact(" ")


def test_causality(engine):
    nodes, edges, whole = engine.run_causality("01")
    assert not whole.first().truncated
    kinds = sorted(r.kind for r in nodes.collect())
    assert kinds == ["fact", "scrape", "scrape", "search", "search", "url", "url"]
    ids = {r.id for r in nodes.collect()}
    assert all(e.source in ids and e.target in ids for e in edges.collect()) and edges.where("target = 'url:03'").count() == 2
    small, _, part = engine.run_causality("01", 1)
    assert part.first().truncated
    assert small.where("kind = 'url'").count() == 1


def test_explore(engine, spark, root):
    found, note = engine.explore(FACT)
    rows = found.orderBy("place").collect()
    assert note == "" and [r.id for r in rows] == ["09", "0a"] and rows[0].distance == pytest.approx(0, abs=1e-4)
    assert engine.explore(FACT, 1)[0].count() == 1
    for state in ("none", "migrating"):
        found, note = Engine(spark, root, vectors_state=state).explore("x")
        assert found.count() == 0 and note
    assert engine.projection(1).count() == 1 and engine.reembedded().count() == 3


def test_resolver(engine, spark, root):
    questions = spark.createDataFrame([("1", FACT), ("2", " Fixture   TERM"), ("3", "zzzz qqqq 1234"), ("4", "Fixture Archive")], "id string, term string")
    strict = Settings(memory=Memory(similarity_threshold=0.9999))
    got = {r.id: r.source for r in Engine(spark, root, strict, StubEmbedder(), now=NOW).answer(questions).collect()}
    assert got["1"] == "memory" and got["2"] == "cache" and got["4"] == "cache"
    blind = {r.id: r.source for r in Engine(spark, root, now=NOW).answer(questions).collect()}
    assert blind == {"1": "live", "2": "cache", "3": "live", "4": "cache"}
    judged = {r.id: (r.source, r.answer) for r in Engine(spark, root, embedder=StubEmbedder(), chat=ExtractiveChat(), now=NOW).answer(questions).collect()}
    assert judged["1"] == ("memory", f"- {FACT}")
    sources = spark.createDataFrame([("a", "cache"), ("a", "live"), ("b", "cache"), ("c", None)], "request string, source string")
    assert {r.request: r.source for r in resolver.combined(sources, "request").collect()} == {"a": "mixed", "b": "cache", "c": "live"}
    assert resolver.distil_prompt("é" * 10, limit=5)[1] == "éé"


def test_destinations(spark):
    raw = ["https://www.google.com/url?q=https%3A%2F%2Fa.example%2Fx", "https://policies.google.com/p", "#top", "javascript:void(0)", "http://a.example/x/", "https://b.example/y#part", "https://c.gstatic.com/z"]
    rows = urls.destinations(spark.createDataFrame([("1", raw), ("2", []), ("3", None)], "id string, links array<string>"), "google").orderBy("position").collect()
    assert [(r.url, r.position) for r in rows] == [("https://a.example/x", 1), ("https://b.example/y", 2)]


def test_result_links():
    page = '<a href="/menu">m</a><div id="rso"><a href="/1">1</a><p><a href="/2">2</a></p><a href="/1">1</a></div><a href="/end">e</a>'
    assert result_links(page) == ["/1", "/2"] and result_links(page, frozenset()) == ["/menu", "/1", "/2", "/end"] and result_links(None) == []


def test_vector_text(spark):
    df = spark.createDataFrame([("[1,0.5,-2]",), ("[]",), ("[1,no]",), (None,)], "t string")
    assert [r.v for r in df.select(vectors.parsed_vector(F.col("t")).alias("v")).collect()] == [[1.0, 0.5, -2.0], [], None, None]
    assert df.limit(1).select(vectors.vector_text(vectors.parsed_vector(F.col("t"))).alias("v")).first().v == "[1,0.5,-2]"
