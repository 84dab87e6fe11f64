"""Exact cosine search, semantic lookups, projection."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import OWNER_KINDS
from quern.functions.tiers import fresh, recent_enough
from quern.operators import tiles

#: Queries that are at home in one task, vectors that stream past them there, and tasks at most.
QUERY_BLOCK, VISITORS, MOST_TASKS = 16_384, 8192, 20_000
DIGITS = 5
#: Tasks that add the partitions' matrices for the covariance.
COVARIANCE_FANIN = 8


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double; null where a vector is all zeros, null or of another length."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(a) == F.size(b), 1 - product / F.nullif(norm(a) * norm(b), F.lit(0.0)))


def current(vectors: DataFrame, model: str = "emb-v1", dim: int = 128) -> DataFrame:
    """(owner_kind, id, embedding) of the active generation; each owner once, unusable vectors left out."""
    good = (F.col("model") == model) & (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    return vectors.where(good).groupBy("owner_kind", "id").agg(F.max_by("embedding", F.coalesce(F.col("created_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))).alias("embedding"))


def id_number(column: str = "id") -> Column:
    """The last eight hexadecimal digits of an id as a number."""
    return F.conv(F.right(column, F.lit(8)), 16, 10).cast("bigint")


def search(vectors: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, owner_kind, id, distance, position): the k nearest vectors of each kind for every query.

    ``vectors`` has owner_kind, id and embedding, ``queries`` id and embedding, all usable and of one length.
    Distances are rounded to 5 decimals, ties go to the smaller id. Queries stay distributed: blocks of
    QUERY_BLOCK of them are at home in tasks past which the vectors stream, each once for each block.
    """
    k = k if k > 0 else 8
    homes, splits = (max(1, -(-df.count() // rows)) for df, rows in ((queries, QUERY_BLOCK), (vectors, VISITORS)))
    by_id = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    name, vector = F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")
    asked = queries.select(F.lit(0).alias("role"), F.lit("").alias("owner_kind"), name, vector, by_id(homes).alias("block"), every(splits).alias("split"))
    known = vectors.select(F.lit(1).alias("role"), "owner_kind", name, vector, every(homes).alias("block"), by_id(splits).alias("split"))
    rows = asked.unionByName(known).withColumn("task", F.col("block") * splits + F.col("split"))
    found = tiles.block_join(rows.withColumn("home", F.col("task")), min(homes * splits, MOST_TASKS), k, DIGITS, mutual=False)
    best = tiles.merged(found, k, "owner_kind", "id")
    return best.select(F.col("id").alias("query_id"), "owner_kind", F.col("neighbour").alias("id"), (F.round(1 - F.col("similarity"), DIGITS) + 0.0).alias("distance"), "position")


def retrieved_facts(found: DataFrame, facts: DataFrame, threshold: float) -> DataFrame:
    """Hits on facts at or above a similarity, with the fact; the cut to k came before, missing owners drop out."""
    near = found.where((F.col("owner_kind") == "memory") & (F.round(1 - F.col("distance"), DIGITS) >= threshold))
    return near.join(facts, "id").select("query_id", "id", "text", F.round(1 - F.col("distance"), DIGITS).alias("similarity"))


def cached_answers(found: DataFrame, cache: DataFrame, threshold: float, now: datetime) -> DataFrame:
    """For each query the nearest cached search above a similarity that is still fresh."""
    near = found.where((F.col("owner_kind") == "search") & (F.round(1 - F.col("distance"), DIGITS) >= threshold))
    alive = near.join(cache, "id").where(fresh(F.lit(now), F.col("expires_at"), F.col("fetched_at")))
    return alive.groupBy("query_id").agg(F.min(F.struct("distance", "id", "query_norm")).alias("m")).select("query_id", "m.id", "m.query_norm", "m.distance")


def gated_facts(found: DataFrame, facts: DataFrame, threshold: float, now: datetime) -> DataFrame:
    """Facts that pass the gates of similarity, of expiry and of the age that their volatility allows."""
    near = found.where((F.col("owner_kind") == "memory") & (F.round(1 - F.col("distance"), DIGITS) >= threshold))
    usable = fresh(F.lit(now), F.col("expires_at"), F.col("fetched_at")) & recent_enough(F.lit(now), F.col("fetched_at"), F.col("volatility"))
    return near.join(facts, "id").where(usable).select("query_id", "id", F.round(1 - F.col("distance"), DIGITS).alias("similarity"))


def owners(facts: DataFrame, cache: DataFrame) -> DataFrame:
    """(owner_kind, id, label, source_url): whatever a vector can belong to."""
    one = facts.select(F.lit("memory").alias("owner_kind"), "id", F.col("text").alias("label"), F.coalesce("source_url", F.lit("")).alias("source_url"))
    return one.unionByName(cache.select(F.lit("search").alias("owner_kind"), "id", F.col("query").alias("label"), F.lit("").alias("source_url")))


def explore(found: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The k nearest of all kinds for each query, resolved to their owners; memory comes before search on ties."""
    order = Window.partitionBy("query_id").orderBy("distance", "owner_kind", "id")
    resolved = found.join(known, ["owner_kind", "id"])
    return resolved.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "place", "owner_kind", "id", "distance", "label")


def totals(vectors: DataFrame) -> DataFrame:
    """(owner_kind, n), with a row for every known kind."""
    counts = vectors.groupBy("owner_kind").agg(F.count("*").alias("n"))
    kinds = vectors.sparkSession.createDataFrame([(v,) for v in OWNER_KINDS], "owner_kind string")
    return kinds.join(counts, "owner_kind", "full_outer").select("owner_kind", F.coalesce("n", F.lit(0)).alias("n"))


def orphans(vectors: DataFrame, known: DataFrame) -> DataFrame:
    """Vectors whose owner is gone."""
    return vectors.select("owner_kind", "id").distinct().join(known.select("owner_kind", "id"), ["owner_kind", "id"], "left_anti")


def covariance(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and number of vectors; the matrices of the partitions are added in rounds of COVARIANCE_FANIN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim + 1, dim + 1)), 0
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, dim)
                x = np.hstack([x, np.ones((len(x), 1))])
                total += x.T @ x
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["m", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim + 1) ** 2), 0
        for batch in batches:
            for m, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total += np.frombuffer(m)
                n += count
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["m", "n"])

    sums = vectors.select("embedding").mapInArrow(run, "m binary, n bigint")
    sums = sums.repartition(COVARIANCE_FANIN).mapInArrow(add, "m binary, n bigint").coalesce(1).mapInArrow(add, "m binary, n bigint")
    r = sums.first()
    total, n = np.frombuffer(r.m).reshape(dim + 1, dim + 1), r.n
    if not n:
        return np.zeros(dim), np.zeros((dim, dim)), 0
    mean = total[-1, :-1] / n
    return mean, total[:-1, :-1] / n - np.outer(mean, mean), n


def sample_page(vectors: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """(owner_kind, id, total, truncated): a page of vectors in the order of kind and id, and whether more follow.

    The page is counted before owners that are gone drop out of it.
    """
    total = vectors.agg(F.count("*").alias("total"))
    shown = vectors.select("owner_kind", "id").orderBy("owner_kind", "id").offset(max(0, offset)).limit(limit)
    sized = shown.agg(F.count("*").alias("shown"))
    flags = total.join(F.broadcast(sized)).select("total", (F.col("shown") + max(0, offset) < F.col("total")).alias("truncated")).first()
    return shown.select("owner_kind", "id", F.lit(flags.total).alias("total"), F.lit(flags.truncated).alias("truncated"))


def project(vectors: DataFrame, dim: int = 128) -> DataFrame:
    """(owner_kind, id, x, y): the vectors on their two main axes; the largest loading of an axis is positive.

    A single vector and identical vectors lie in the origin.
    """
    mean, cov, _ = covariance(vectors, dim)
    values, axes = np.linalg.eigh(cov)
    axes = axes[:, ::-1][:, :2] * (values[::-1][:2] > 1e-12)
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), [0, 1]] < 0, -1, 1)
    shared = vectors.sparkSession.sparkContext.broadcast((mean, axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, main = shared.value
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(2).flatten(), np.float64).reshape(batch.num_rows, dim)
                p = (x - centre) @ main
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p[:, 0]), pa.array(p[:, 1])], names=["owner_kind", "id", "x", "y"])

    return vectors.select("owner_kind", "id", "embedding").mapInArrow(run, "owner_kind string, id string, x double, y double")


def scaled_to_box(points: DataFrame, width: float = 640, height: float = 480, margin: float = 16) -> DataFrame:
    """Points fitted into a box with a margin, y pointing down; an axis without extent goes to the middle."""
    ends = points.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def place(c: str, size: float) -> Column:
        low, high = ends[f"lo_{c}"], ends[f"hi_{c}"]
        share = (F.col(c) - low) / (high - low) if low is not None and high > low else F.lit(0.5)
        return margin + (share if c == "x" else 1 - share) * (size - 2 * margin)

    return points.select("owner_kind", "id", place("x", width).alias("px"), place("y", height).alias("py"))


def parsed_vector(text: Column) -> Column:
    """A vector from its text, like ``[1,0.5]``; null where a component is no number."""
    values = F.from_json(text, "array<float>")
    return F.when(F.exists(values, lambda x: x.isNull()), None).otherwise(values)


def vector_text(vector: Column) -> Column:
    """A vector as text; whole numbers without a point."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), ","), F.lit("]"))
