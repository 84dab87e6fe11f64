"""State transitions as pure functions: (state, changes, now) to the new state."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.config import Tiers
from quern.functions.ids import minted_id
from quern.functions.tiers import expiry, interval, promoted


def upsert(state: DataFrame, changes: DataFrame, key: str | list[str], keep: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """Rows of ``changes`` replace those with the same key, but ``keep`` stays; new keys are added.

    ``changes`` has the columns of ``state`` and one row for each key, of one column or several. A null key
    matches nothing.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in state.columns if c not in keys]
    new = changes.select(*keys, F.struct(*rest).alias("__new"))
    joined = state.select(*keys, F.struct(*rest).alias("__old")).join(new, keys, "full_outer")
    pick = lambda c: F.coalesce(f"__old.{c}", f"__new.{c}") if c in keep else F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))
    return joined.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in state.columns])


def insert_or_ignore(state: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Adds rows with new keys, of several the one with the least ``order``; what is there stays."""
    payload = [c for c in state.columns if c not in (*key, order)]
    first = rows.groupBy(*key).agg(F.min(F.struct(order, *payload)).alias("m")).select(*key, "m.*").select(*state.columns)
    return state.unionByName(first.join(state.select(*key), key, "left_anti"))


def expanded_searches(searches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of finished searches with html and urls: rows of search_raw, urls and search_urls; rank counts from 1."""
    raw = searches.where("html <> ''").select(F.col("id").alias("search_id"), "html", F.octet_length("html").cast("bigint").alias("byte_size"), "created_at")
    links = searches.select(F.col("id").alias("search_id"), "created_at", F.posexplode("urls").alias("p", "url")).select("search_id", (F.col("p") + 1).alias("rank"), "url", "created_at")
    urls = links.groupBy("url").agg(F.min("created_at").alias("first_seen_at"))
    return raw, urls, links.groupBy("search_id", "url").agg(F.min("rank").alias("rank"))


def stored_searches(cache: DataFrame, answers: DataFrame, now: datetime, settings: Tiers = Tiers()) -> DataFrame:
    """The query cache after new answers (query_norm, query, results, tier): hits are reset, the window begins anew."""
    at = F.lit(now)
    fresh = answers.select(
        F.concat(F.lit("new:"), F.sha2("query_norm", 256)).alias("id"), "query_norm", "query", "results", "tier", F.lit(0).alias("hit_count"), expiry(at, F.col("tier"), settings).alias("expires_at"), at.alias("fetched_at"), at.alias("created_at"), at.alias("updated_at")
    )
    return upsert(cache, fresh.select(*cache.columns), "query_norm")


def saved_pages(cache: DataFrame, fetched: DataFrame, now: datetime, settings: Tiers = Tiers()) -> DataFrame:
    """The page cache after fetches, one row for each url, of failed and forbidden ones too.

    Whatever was cached, a fetched page is short-lived again, has no hits and the hash of its new content; id
    and creation stay. Columns of ``cache`` that ``fetched`` lacks are null; new pages get a minted id.
    """
    at = F.lit(now)
    have = lambda c: F.col(c) if c in fetched.columns else F.lit(None)
    content = F.coalesce(*[F.nullif(have(c).cast("string"), F.lit("")) for c in ("text_content", "clean_html", "raw_html")])
    ruled = {"id": minted_id(at, F.col("url")), "tier": F.lit("short"), "hit_count": F.lit(0), "content_hash": F.sha2(content, 256), "expires_at": expiry(at, F.lit("short"), settings), "fetched_at": at, "created_at": at, "updated_at": at}
    types = dict(cache.dtypes)
    return upsert(cache, fetched.select(*[(ruled[c] if c in ruled else have(c)).cast(types[c]).alias(c) for c in cache.columns]), "url")


def started_runs(runs: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """The runs with new ones (id, mode, artifact_dir), begun now and not finished; ids that are there stay as they are."""
    at = F.lit(now)
    rows = new.dropDuplicates(["id"]).join(runs.select("id"), "id", "left_anti").select("id", "mode", "artifact_dir", at.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), at.alias("created_at"))
    return runs.unionByName(rows.select(*runs.columns))


def finished_runs(runs: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    """The runs with those of ``ids`` (id) finished now."""
    done = runs.join(ids.select("id").distinct().withColumn("__done", F.lit(True)), "id", "left")
    return done.withColumn("finished_at", F.when(F.col("__done"), F.lit(now)).otherwise(F.col("finished_at"))).select(*runs.columns)


def trimmed_raw(raw: DataFrame, now: datetime, max_age: timedelta, keep_last: int) -> DataFrame:
    """Result pages (search_raw) without those that are older than ``max_age`` and not among the ``keep_last`` newest."""
    kept = raw.select("id", "created_at").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(max(0, keep_last)).select("id", F.lit(True).alias("__kept"))
    marked = raw.join(F.broadcast(kept), "id", "left")  # keep_last rows
    return marked.where((F.col("created_at") >= F.lit(now) - interval(max_age)) | F.col("__kept")).select(*raw.columns)


def to_embed(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """Queries that are new to the cache and need a vector."""
    return answers.join(cache.select("query_norm"), "query_norm", "left_anti").select("query_norm", "query")


def touched(rows: DataFrame, hits: DataFrame, now: datetime, settings: Tiers = Tiers(), refetched: bool = False) -> DataFrame:
    """Rows after ``hits`` (id, n): hit_count, tier and expiry move on; rows without hits stay as they are."""
    at, counted = F.lit(now), F.col("hit_count") + F.coalesce("__n", F.lit(0))
    hit = F.col("__n") > 0
    joined = rows.join(hits.groupBy("id").agg(F.sum("n").cast("int").alias("__n")), "id", "left")
    tier = F.when(hit, promoted(F.col("tier"), counted, settings)).otherwise(F.col("tier"))
    changes = {"hit_count": counted, "tier": tier, "expires_at": F.when(hit, expiry(at, tier, settings)).otherwise(F.col("expires_at"))}
    if "updated_at" in rows.columns:
        changes["updated_at"] = F.when(hit, at).otherwise(F.col("updated_at"))
    if refetched:
        changes["fetched_at"] = F.when(hit, at).otherwise(F.col("fetched_at"))
    return joined.withColumns(changes).select(*rows.columns)


def unexpired(rows: DataFrame, now: datetime) -> DataFrame:
    """Rows whose expiry is not past; none never passes."""
    return rows.where(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now)))


def expired(rows: DataFrame, now: datetime) -> DataFrame:
    return rows.where(F.col("expires_at") < F.lit(now))


def cascade(vectors: DataFrame, gone: dict[str, DataFrame]) -> DataFrame:
    """Vectors without those of owners that are gone; ``gone`` has ids by owner kind."""
    ids = None
    for kind, df in gone.items():
        one = df.select(F.lit(kind).alias("owner_kind"), "id")
        ids = one if ids is None else ids.unionByName(one)
    return vectors.join(ids, ["owner_kind", "id"], "left_anti") if ids is not None else vectors


def trimmed(pages: DataFrame, now: datetime, max_age: timedelta, keep_last: int) -> DataFrame:
    """Pages without the HTML of those that are older than ``max_age`` and not among the ``keep_last`` newest."""
    newest = pages.select("id", "created_at").orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(max(0, keep_last)).select("id", F.lit(True).alias("__kept"))
    marked = pages.join(F.broadcast(newest), "id", "left")  # keep_last rows
    drop = (F.col("created_at") < F.lit(now) - interval(max_age)) & F.col("__kept").isNull()
    return marked.withColumns({c: F.when(~drop, F.col(c)) for c in ("raw_html", "clean_html")}).select(*pages.columns)


def refreshed(wanted: DataFrame, cache: DataFrame, fetched: DataFrame, now: datetime) -> DataFrame:
    """(url, outcome) of addresses to scrape: cache, cache-revalidated or http.

    ``cache`` has url and expires_at, ``fetched`` url and status of what was asked of the network.
    """
    known = cache.groupBy("url").agg(F.max(F.struct(F.coalesce("expires_at", F.lit(datetime(9999, 12, 31))).alias("until"))).alias("c"))
    joined = wanted.select("url").distinct().join(known, "url", "left").join(fetched.groupBy("url").agg(F.min("status").alias("status")), "url", "left")
    outcome = F.when(F.col("c.until") >= F.lit(now), "cache").when(F.col("c").isNotNull() & (F.col("status") == 304), "cache-revalidated").otherwise("http")
    return joined.select("url", outcome.alias("outcome"))


def latest(changelog: DataFrame, key: str, version: str) -> DataFrame:
    """Current rows of an append-only log of row versions."""
    payload = [c for c in changelog.columns if c not in (key, version)]
    return changelog.groupBy(key).agg(F.max(F.struct(version, *payload)).alias("m")).select(key, "m.*")


def matched_facts(found: DataFrame, threshold: float) -> DataFrame:
    """(new_id, fact_id): the stored fact that a new one overwrites, where the nearest is similar enough.

    ``found`` is the search of the new facts' vectors among those of stored facts, with k = 1.
    """
    near = found.where((F.col("position") == 1) & (F.col("owner_kind") == "memory") & (F.round(1 - F.col("distance"), 5) >= threshold))
    return near.select(F.col("query_id").alias("new_id"), F.col("id").alias("fact_id"))


def stored_facts(facts: DataFrame, new: DataFrame, matches: DataFrame, now: datetime, settings: Tiers = Tiers()) -> DataFrame:
    """Facts after a batch of new ones (id, text, source_url, volatility, tier).

    A match overwrites text, source and volatility and keeps id, hits and creation; of several new facts that
    match one stored fact the last by id wins. The others are added. The batch is not matched with itself.
    """
    at = F.lit(now)
    pairs = new.join(matches, new.id == matches.new_id, "left").select(new["*"], "fact_id")
    order = Window.partitionBy("fact_id").orderBy(F.col("id").desc())
    over = pairs.where("fact_id is not null").withColumn("r", F.row_number().over(order)).where("r = 1").select(F.col("fact_id").alias("id"), F.struct("text", "source_url", "volatility").alias("__new"))
    joined = facts.join(over, "id", "left")
    hit = F.col("__new").isNotNull()
    tier = F.when(hit, promoted(F.col("tier"), F.col("hit_count"), settings)).otherwise(F.col("tier"))
    kept = joined.withColumns({c: F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in ("text", "source_url", "volatility")} | {"tier": tier, "expires_at": F.when(hit, expiry(at, tier, settings)).otherwise(F.col("expires_at")), "fetched_at": F.when(hit, at).otherwise(F.col("fetched_at")), "updated_at": F.when(hit, at).otherwise(F.col("updated_at"))}).select(*facts.columns)
    added = pairs.where("fact_id is null").select("id", "text", "source_url", "volatility", "tier", F.lit(0).alias("hit_count"), expiry(at, F.col("tier"), settings).alias("expires_at"), at.alias("fetched_at"), at.alias("created_at"), at.alias("updated_at"))
    return kept.unionByName(added.select(*facts.columns))
