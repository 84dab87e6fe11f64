"""Transitions, queue, store, streams and vector reads on small tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.config import Jobs
from quern.operators import jobs, lifecycle, vectors
from quern.operators.records import records
from quern.runtime import newest
from quern.schemas import DDL, schema
from quern.sources.fetch import PageSource, Response, crawl
from quern.sources.models import ExtractiveChat, StubEmbedder, embedded
from quern.sources.store import Locked, SnapshotStore
from quern.streaming import logs
from quern.streaming.expiry import sliding_expiry
from quern.streaming.queue import step

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
DAY = timedelta(days=1)


def job(id_, status="pending", attempts=0, at=NOW, locked=None, kind="embed"):
    return (id_, kind, "{}", status, attempts, at, locked, NOW, NOW)


def test_newest(spark):
    df = spark.createDataFrame([("a", 1, NOW), ("a", 2, NOW + DAY), ("b", 3, None), (None, 4, None)], "id string, v int, t timestamp")
    assert sorted((r.id or "", r.v) for r in newest(df, "id", "t", "v").collect()) == [("", 4), ("a", 2), ("b", 3)]


def test_upsert_is_idempotent(spark):
    s = "id string, created_at timestamp, k string, v int"
    state = spark.createDataFrame([("1", NOW, "a", 1), ("2", NOW, "b", None)], s)
    change = spark.createDataFrame([("9", NOW + DAY, "a", None), ("8", NOW + DAY, "c", 3)], s)
    once = lifecycle.upsert(state, change, "k")
    assert sorted((r.id, r.k, r.v) for r in once.collect()) == [("1", "a", None), ("2", "b", None), ("8", "c", 3)]
    assert sorted(map(str, lifecycle.upsert(once, change, "k").collect())) == sorted(map(str, once.collect()))


def test_insert_or_ignore(spark):
    s = "a string, b string, rank int"
    out = lifecycle.insert_or_ignore(spark.createDataFrame([("x", "y", 5)], s), spark.createDataFrame([("x", "y", 1), ("p", "q", 3), ("p", "q", 2)], s), ["a", "b"], "rank")
    assert sorted(map(tuple, out.collect())) == [("p", "q", 2), ("x", "y", 5)]


def test_expanded_searches(spark):
    df = spark.createDataFrame([("s", "<é>", ["u", "v", "u"], NOW), ("t", "", [], NOW)], "id string, html string, urls array<string>, created_at timestamp")
    raw, found, links = lifecycle.expanded_searches(df)
    assert [r.byte_size for r in raw.collect()] == [4] and found.count() == 2
    assert sorted((r.url, r["rank"]) for r in links.collect()) == [("u", 1), ("v", 2)]


def test_cleanup_and_cascade(spark):
    rows = spark.createDataFrame([("a", NOW - DAY), ("b", NOW), ("c", None)], "id string, expires_at timestamp")
    kept = lifecycle.unexpired(rows, NOW)
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in lifecycle.unexpired(kept, NOW).collect()) == ["b", "c"]
    v = spark.createDataFrame([("memory", "a"), ("search", "a")], "owner_kind string, id string")
    assert [tuple(r) for r in lifecycle.cascade(v, {"memory": lifecycle.expired(rows, NOW)}).collect()] == [("search", "a")]
    assert lifecycle.cascade(v, {}).count() == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["short", "long", "permanent"]), st.integers(0, 5)), min_size=1, max_size=6))
def test_promotion_is_monotone(spark, rows):
    df = spark.createDataFrame([(str(i), t, h, NOW) for i, (t, h) in enumerate(rows)], "id string, tier string, hit_count int, expires_at timestamp")
    hits = df.select("id", F.lit(1).alias("n"))
    rank = {"short": 0, "long": 1, "permanent": 2}
    for r in lifecycle.touched(df, hits, NOW).collect():
        tier, n = rows[int(r.id)]
        assert rank[r.tier] >= rank[tier] and r.hit_count == n + 1 and (r.expires_at is None) == (tier == "permanent")


def test_trimmed(spark):
    old = NOW - 5 * DAY
    df = spark.createDataFrame([(str(i), old + timedelta(hours=i), "r", "c") for i in range(5)] + [("n", NOW, "r", None)], "id string, created_at timestamp, raw_html string, clean_html string")
    out = {r.id: r.raw_html for r in lifecycle.trimmed(df, NOW, timedelta(hours=48), 2).collect()}
    assert out == {"0": None, "1": None, "2": None, "3": None, "4": "r", "n": "r"}


def test_stored_facts(spark):
    facts = spark.createDataFrame([("f", "old", None, "stable", "short", 3, None, NOW, NOW, NOW)], schema("memory_facts"))
    new = spark.createDataFrame([("x", "new", "u", "volatile", "short"), ("y", "other", None, None, "long")], "id string, text string, source_url string, volatility string, tier string")
    match = spark.createDataFrame([("x", "f")], "new_id string, fact_id string")
    out = {r.id: r for r in lifecycle.stored_facts(facts, new, match, NOW + DAY).collect()}
    assert set(out) == {"f", "y"} and out["f"].text == "new" and out["f"].hit_count == 3 and out["f"].tier == "long" and out["y"].hit_count == 0


def test_queue(spark):
    rows = [job("a"), job("b", at=NOW - DAY), job("c", "running", 4, locked=NOW - DAY), job("d", "running", 1, locked=NOW), job("e", at=NOW + DAY)]
    q = spark.createDataFrame(rows, DDL["jobs"])
    assert [r.id for r in jobs.claimable(q, NOW, 1).collect()] == ["b"]
    assert {r.id: r.status for r in jobs.claimed(q, NOW, 1).collect()}["b"] == "running"
    out = {r.id: r for r in jobs.settled(q, spark.createDataFrame([("a", True), ("c", False), ("d", False)], "id string, ok boolean"), NOW).collect()}
    assert (out["a"].status, out["c"].status, out["c"].attempts, out["d"].status, out["d"].attempts) == ("done", "failed", 4, "pending", 2)
    assert out["d"].run_after.replace(tzinfo=timezone.utc) == NOW + timedelta(seconds=4)
    assert {r.id: r.status for r in jobs.reaped(q, NOW).collect()}["c"] == "pending"
    assert {r.status: r.n for r in jobs.status_counts(q).collect()} == {"pending": 3, "running": 2, "done": 0, "failed": 0}
    assert jobs.timing(q, 5).first().sampled == 0 and jobs.enqueued(q, spark.createDataFrame([("n", "t", "")], "id string, type string, payload string"), NOW).count() == 6

    def fail(payload):
        raise RuntimeError

    done = {r.id: r.status for r in step(q, {"embed": fail}, NOW, 10, Jobs(max_attempts=1)).collect()}
    assert done["a"] == done["b"] == "failed" and done["e"] == "pending"


def test_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.read("runs").count() == 0 and store.vectors_state() == "none"
    rows = spark.createDataFrame([("1", "serve", None, NOW, None, NOW)], schema("runs"))
    with store:
        store.commit({"vector_generation": "1"}, runs=rows)
        with pytest.raises(Locked), SnapshotStore(spark, str(tmp_path / "s")):
            pass
        store.commit({"vector_migration": "x"}, runs=store.read("runs").unionByName(rows.withColumn("id", F.lit("2"))))
    assert store.read("runs").count() == 2 and store.vectors_state() == "migrating"
    store.commit({"vector_migration": None})
    before, after = store.compact()
    assert after < before and store.read("runs").count() == 2 and store.vectors_state() == "ready"


def test_search_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([("memory" if i % 3 else "search", f"{i:03}", x[i].tolist()) for i in range(300)], "owner_kind string, id string, embedding array<float>").repartition(5)
    asked = df.where("id < '007'")
    found = vectors.search(df, asked, 4).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for kind in ("memory", "search"):
        mine = [i for i in range(300) if (i % 3 > 0) == (kind == "memory")]
        for q in range(7):
            want = sorted((round(float(1 - u[q] @ u[i]), 5), f"{i:03}") for i in mine)[:4]
            assert sorted((r.distance, r.id) for r in found if r.query_id == f"{q:03}" and r.owner_kind == kind) == want
    assert vectors.search(df, asked.limit(0), 4).count() == 0 and vectors.search(df.limit(0), asked, 4).count() == 0


def test_projection(spark):
    near = [("memory", f"a{i}", [10.0 + i * 0.01, 0.0, 0.0]) for i in range(5)] + [("memory", f"b{i}", [-10.0, 0.5, 0.01 * i]) for i in range(5)]
    s = "owner_kind string, id string, embedding array<float>"
    out = {r.id: r.x for r in vectors.project(spark.createDataFrame(near, s), 3).collect()}
    assert min(v for k, v in out.items() if k[0] == "a") > max(v for k, v in out.items() if k[0] == "b")
    same = vectors.project(spark.createDataFrame([("m", "1", [1.0, 2.0, 3.0])] * 2, s), 3)
    assert {(round(r.x, 9), round(r.y, 9)) for r in same.collect()} == {(0.0, 0.0)}
    assert {(r.px, r.py) for r in vectors.scaled_to_box(same).collect()} == {(320.0, 240.0)}
    assert vectors.project(spark.createDataFrame([], s), 3).count() == 0


def test_cosine_expression(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [None if v is None else round(v, 9) for (v,) in df.select(vectors.cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None, None]


def test_models(spark):
    stub = StubEmbedder()
    assert np.isclose(np.linalg.norm(stub.embed(["abc"])[0]), 1) and stub.embed([""])[0] == np.eye(8)[0].tolist()
    rows = spark.createDataFrame([("1", "a fact"), ("2", "  "), ("3", None)], "id string, text string")
    assert [(r.id, r.dim) for r in embedded(rows, stub, "memory").collect()] == [("1", 8)]
    assert ExtractiveChat().chat("", "- the bridge is closed\n\nis the bridge open") != "INSUFFICIENT" == ExtractiveChat().chat("", "- a\n\nunrelated")


def test_crawl(spark):
    def transport(url, headers):
        if url.endswith("robots.txt"):
            return Response(200, "User-agent: *\nDisallow: /private") if "a.example" in url else Response(503)
        if headers.get("If-None-Match"):
            return Response(304)
        return Response(200, "é" * 10, {"ETag": "x"})

    df = spark.createDataFrame([("https://a.example/x", None, None), ("https://a.example/private/y", None, None), ("https://a.example/z", "tag", None), ("https://b.example/x", None, None), ("junk", None, None)], "url string, etag string, last_modified string")
    out = {r.url: (r.status, r.body, r.etag, r.allowed) for r in crawl(df, transport, most_bytes=5).collect()}
    assert out == {"https://a.example/x": (200, "éé", "x", True), "https://a.example/private/y": (None, None, None, False), "https://a.example/z": (304, "", None, True), "https://b.example/x": (None, None, None, False)}


def test_page_source(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>é")
    spark.dataSource.register(PageSource)
    assert [(r.url, r.byte_size) for r in spark.read.format("quern_pages").option("path", str(tmp_path)).load().collect()] == [("https://pages.invalid/a.html", 5)]


def test_log_stream_equals_batch(spark, data, tmp_path):
    from quern.sources import lens

    stream = lens.log_rows(logs.stream_of(spark, f"{data}/event[s].parquet"))
    logs.drain(logs.deduplicated(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == lens.logs(spark, data).select("id").distinct().count()


def test_sliding_expiry(spark, tmp_path):
    hits = tmp_path / "hits"
    write = lambda rows: spark.createDataFrame(rows, "key string, at timestamp").coalesce(1).write.mode("append").parquet(str(hits))
    write([("a", NOW)] * 3 + [("b", NOW)])
    stream = spark.readStream.schema("key string, at timestamp").parquet(str(hits))
    out: list = []

    def run():
        query = sliding_expiry(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    assert {(r.key, r.tier) for r in out} == {("a", "long"), ("b", "short")}
    write([("c", NOW + 20 * DAY)])
    run()
    assert {r.key for r in out if r.expired} == {"b"}


def test_empty_tables(spark, tmp_path):
    """Reads over empty tables give empty or zero results."""
    from quern.operators import provenance, runs, stats

    for table in ("runs", "searches", "urls", "search_urls", "scrape_cache", "memory_facts", "search_cache", "vectors"):
        spark.createDataFrame([], schema(table)).write.parquet(f"{tmp_path}/{table}.parquet")
    root = str(tmp_path)
    assert runs.run_urls(spark, root).count() == runs.list_runs(spark, root).count() == provenance.url_provenance(spark, root).count() == 0
    nodes, edges, _ = provenance.causality(spark, root)
    assert nodes.count() == edges.count() == 0 and {r.n for r in provenance.node_counts(nodes).collect()} == {0}
    assert {r.value for r in stats.snapshot(spark, root, NOW).collect()} == {0}
    assert records(spark, root, "vectors").count() == 0


def test_keys_of_several_columns(spark):
    state = spark.createDataFrame([("m", "1", 1), ("s", "1", 2)], "owner_kind string, id string, n int")
    change = spark.createDataFrame([("s", "1", 7), ("s", "2", 8)], state.schema)
    assert sorted(map(tuple, lifecycle.upsert(state, change, ["owner_kind", "id"]).collect())) == [("m", "1", 1), ("s", "1", 7), ("s", "2", 8)]


def test_replaced_deliveries_are_left_out(spark):
    from quern.runtime import current_rows

    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), (None, 1), (None, 3)], "id string, at int")
    assert sorted(map(str, current_rows(df, "id", "at").collect())) == sorted(map(str, spark.createDataFrame([("a", 2), ("b", 1), ("b", 1), (None, 3)], df.schema).collect()))


def test_saved_pages_start_anew(spark):
    cache = spark.createDataFrame([("x", "u1", "long", 9, "h", "t", NOW - timedelta(days=9), NOW - timedelta(days=9), NOW - timedelta(days=9), NOW)], "id string, url string, tier string, hit_count int, content_hash string, text_content string, created_at timestamp, updated_at timestamp, fetched_at timestamp, expires_at timestamp")
    fetched = spark.createDataFrame([("u1", None), ("u2", "hello")], "url string, text_content string")
    rows = {r.url: r for r in lifecycle.saved_pages(cache, fetched, NOW).collect()}
    assert (rows["u1"].id, rows["u1"].tier, rows["u1"].hit_count, rows["u1"].content_hash, rows["u1"].text_content) == ("x", "short", 0, None, None)
    assert rows["u1"].created_at < rows["u1"].fetched_at and len(rows["u2"].id) == 36 and rows["u2"].id[14] == "7" and rows["u2"].content_hash
    assert lifecycle.saved_pages(cache.limit(0), fetched, NOW).where("url = 'u2'").first().id == rows["u2"].id


def test_raw_result_pages_are_trimmed(spark):
    raw = spark.createDataFrame([(str(i), NOW - timedelta(days=i)) for i in range(6)], "id string, created_at timestamp")
    assert sorted(r.id for r in lifecycle.trimmed_raw(raw, NOW, timedelta(days=2), 1).collect()) == ["0", "1", "2"]
    assert sorted(r.id for r in lifecycle.trimmed_raw(raw, NOW, timedelta(hours=1), 3).collect()) == ["0", "1", "2"]


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from quern.runtime import ensure_checkpoint_dir

    defined = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: defined)), getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf={}))
