"""Problem 4: the k most similar vectors of every vector, by an exact block matrix join.

The vectors of a kind are spread over home blocks, which form a ring. Every block stays in its own task and is
streamed past half of the other blocks, so that any two blocks meet once and a block is sent half as often as
there are blocks. In a task int8 codes with error bounds tell which pairs can count, see
:mod:`quern.operators.tiles`; the best rows of all tasks are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import tiles

#: Rows of a home block at most; blocks of a kind at least, and rows below which that is not asked for.
BLOCK_ROWS, LEAST_BLOCKS, SMALL_BLOCK = 65_536, 5, 1024
#: Kinds whose numbers are broadcast at most (with more of them they are joined), and tasks at most.
BROADCAST_KINDS, MOST_TASKS = 100_000, 20_000
DIGITS = 6


def usable(vectors: DataFrame, model: str = "emb-v1", dim: int = 128) -> DataFrame:
    """(owner_kind, id, embedding): rows of ``model`` with ``dim`` numbers, none null or NaN and not all 0; each (owner_kind, id) once."""
    good = (F.col("model") == model) & (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    return vectors.where(good).groupBy("owner_kind", "id").agg(F.max_by("embedding", F.coalesce(F.col("created_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))).alias("embedding"))


def nearest(vectors: DataFrame, k: int = 5) -> DataFrame:
    """(owner_kind, id, neighbour, similarity): the k most similar other vectors of the same owner_kind.

    ``vectors`` has owner_kind, id (each pair once) and embedding, all of one length; null kinds and ids are
    left out. Similarity is the cosine rounded to 6 decimals; ties go to the smaller id. A kind with fewer
    than k + 1 vectors gives fewer rows, an empty table none. The result is exact. A vector is sent once for
    its own block and once for each of half the other blocks of its kind.
    """
    named = vectors.where("owner_kind is not null and id is not null").select("owner_kind", F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    n = F.count("*")
    blocks = F.greatest(F.ceil(n / BLOCK_ROWS), F.least(F.lit(LEAST_BLOCKS), F.ceil(n / SMALL_BLOCK))).cast("int")
    kinds = named.groupBy("owner_kind").agg(blocks.alias("blocks"))
    several, tasks = kinds.agg(F.count("*"), F.sum("blocks")).first()
    if several <= BROADCAST_KINDS:
        first = F.coalesce(F.sum("blocks").over(Window.orderBy("owner_kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kinds = F.broadcast(kinds.withColumn("first", first))
    else:
        kinds = kinds.withColumn("first", F.pmod(F.xxhash64("owner_kind"), F.lit(1 << 40)))
    placed = named.join(kinds, "owner_kind").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block b meets those that follow it on the ring; of two that lie opposite each other the first is at home
    ahead = F.floor(F.col("blocks") / 2).cast("int") - F.when((F.col("blocks") % 2 == 0) & (F.col("block") < F.col("blocks") / 2), 1).otherwise(0)
    homes = F.transform(F.sequence(F.lit(0), ahead), lambda d: F.pmod(F.col("block") - d, F.col("blocks")))
    sent = placed.select("owner_kind", "id", "embedding", "block", "first", F.explode(homes).alias("at"))
    rows = sent.select((F.col("first") + F.col("at")).alias("home"), (F.col("at") != F.col("block")).cast("int").alias("role"), "owner_kind", "id", "embedding")
    tasks = max(1, min(MOST_TASKS, tasks or 0))
    found = tiles.block_join(rows.withColumn("task", F.pmod("home", F.lit(tasks)).cast("int")), tasks, k, DIGITS, mutual=True)
    return tiles.merged(found, k, "owner_kind", "id").drop("position")


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(owner_kind, id_a, id_b), the smaller id first: pairs of which one is a neighbour of the other; once each."""
    return found.select("owner_kind", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
