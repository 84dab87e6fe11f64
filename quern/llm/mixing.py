"""Problem 9: mixing sources to target weights, along a curriculum.

Every source has a weight schedule over training time 0..1, piecewise linear, whose integral is the
source's target share. A copy of a document that begins at the fraction ``u`` of its source's demand is
placed where the integrated schedule reaches ``u``; sorting by that position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.runtime import cut, if_small

#: Rows of a source are spread over ranges of their hash with about so many rows each, so that no running sum sees
#: a whole source; bits of the hash that number the ranges.
RANGE_ROWS, RANGE_BITS = 65_536, (8, 20)


def default_schedule(targets: DataFrame) -> DataFrame:
    """Knots (source, t, weight): the smaller a source's target share, the later its weight rises.

    The weight of a source at time t is its share times ``1 + tilt * (2t - 1)``; the tilts run from -0.5 for
    the largest share to +0.5 for the smallest one. A single source has tilt 0.
    """
    order = Window.orderBy(F.col("target_share").desc(), "source")  # targets hold one row for each source
    ranked = targets.select("source", "target_share", F.percent_rank().over(order).alias("r"), F.count("*").over(Window.partitionBy()).alias("n"))
    tilt = F.when(F.col("n") > 1, F.col("r") - 0.5).otherwise(F.lit(0.0))
    knots = F.array(F.struct(F.lit(0.0).alias("t"), (F.col("target_share") * (1 - tilt)).alias("weight")), F.struct(F.lit(1.0).alias("t"), (F.col("target_share") * (1 + tilt)).alias("weight")))
    return ranked.select("source", F.explode(knots).alias("k")).select("source", "k.t", "k.weight")


def integrate(schedule: DataFrame) -> DataFrame:
    """Pieces (source, t0, t1, w0, w1, u0, u1): u is the integral of the weight, scaled to end at 1."""
    by = Window.partitionBy("source").orderBy("t")
    nxt = schedule.select("source", F.col("t").alias("t0"), F.lead("t").over(by).alias("t1"), F.col("weight").alias("w0"), F.lead("weight").over(by).alias("w1")).where("t1 > t0")
    area = nxt.withColumn("area", (F.col("w0") + F.col("w1")) / 2 * (F.col("t1") - F.col("t0")))
    so_far = Window.partitionBy("source").orderBy("t0").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("area").over(Window.partitionBy("source"))
    return (
        area.withColumn("u1", F.try_divide(F.sum("area").over(so_far), total))
        .withColumn("u0", F.coalesce(F.lag("u1").over(by.orderBy("t0")), F.lit(0.0)))
        .withColumn("scale", total)
        .where("area > 0")
        .drop("area")
    )


def _demand(sized: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """One row for each source of ``targets``: supply, demand in tokens and full passes; as small as ``targets``."""
    supply = sized.groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("documents"))
    total = F.lit(total_tokens) if total_tokens is not None else F.sum("supply").over(Window.partitionBy())
    overall = supply.select("source", "supply", "documents", total.cast("double").alias("total"))
    known = targets.join(overall, "source", "left")
    return known.select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("supply", F.lit(0)).alias("supply"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce(F.max("total").over(Window.partitionBy()), F.lit(0.0)).alias("total"),
    ).withColumn("demand", F.least(F.col("target_share") * F.col("total"), F.col("max_repeats").cast("double") * F.col("supply")))


def mix(sized: DataFrame, targets: DataFrame, schedule: DataFrame | None = None, total_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """Training sequence (position, doc_id, source, copy, n_tokens), sorted by position in 0..1.

    ``sized`` has doc_id, source and n_tokens, ``targets`` source, target_share and max_repeats. The total is
    ``total_tokens`` or the tokens of all rows of ``sized``, whether or not their source has a target. A
    source is passed through completely while its demand allows, then a last part of it, taken in the order
    of a hash of doc_id and ``seed``, so that the demand is met up to half a document; no document is used
    more than max_repeats times. A source that runs out stays below its share, the others do not grow.
    Documents of 0 tokens, of a null source or of a source without target are left out. Null doc_ids are
    kept as documents; repeated rows are separate documents. Empty inputs give no rows.
    """
    targets = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int"))
    sized = sized.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    plan = cut(_demand(sized, targets, total_tokens).where("demand > 0"))
    bits = min(RANGE_BITS[1], max(RANGE_BITS[0], (sized.count() // RANGE_ROWS).bit_length()))
    keyed = sized.where("n_tokens > 0").join(if_small(plan.select("source")), "source", "left_semi")
    keyed = keyed.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("range", F.shiftright("h", 64 - bits))
    sums = keyed.groupBy("source", "range").agg(F.sum("n_tokens").alias("tokens"))  # 2 ** bits rows a source at most
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sums.select("source", "range", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset")))
    within = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        keyed.join(if_small(offsets), ["source", "range"])
        .withColumn("begin", F.col("offset") + F.sum("n_tokens").over(within) - F.col("n_tokens"))
        .join(if_small(plan), "source")
    )
    passes = F.floor(F.col("demand") / F.col("supply")).cast("int")
    rest = F.col("demand") - passes * F.col("supply")
    copies = passes + F.when((F.col("begin") + F.col("n_tokens") / 2 <= rest) & (passes < F.col("max_repeats")), 1).otherwise(0)
    copied = placed.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    u = F.least((F.col("begin") + (F.col("copy") - 1) * F.col("supply")) / F.col("demand"), F.lit(1.0 - 1e-12))
    pieces = integrate(schedule if schedule is not None else default_schedule(targets))
    slope = (F.col("w1") - F.col("w0")) / (F.col("t1") - F.col("t0"))
    need = (F.col("u") - F.col("u0")) * F.col("scale")
    step = F.try_divide(2 * need, F.col("w0") + F.sqrt(F.greatest(F.col("w0") * F.col("w0") + 2 * slope * need, F.lit(0.0))))
    located = (
        copied.select("doc_id", "source", "copy", "n_tokens", u.alias("u"))
        .join(if_small(pieces), "source")
        .where("u >= u0 and (u < u1 or (u1 >= 1 - 1e-9 and u >= u0))")
        .withColumn("position", F.coalesce(F.col("t0") + step, F.col("t0")))
    )
    return located.select("position", "doc_id", "source", "copy", "n_tokens").orderBy("position", "source", "doc_id", "copy")


def shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """For each source of ``targets``: target_share and what the mix reached.

    ``reached_share`` is the source's tokens in the mix over the total, ``share_of_mix`` over the tokens of
    the mix; ``max_uses`` is the greatest number of uses of one document. Sources without rows show 0.
    """
    sized = sized.select("source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    plan = _demand(sized, targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")), total_tokens)
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), F.max("copy").alias("max_uses"))
    joined = plan.join(if_small(used), "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return joined.select(
        "source",
        "target_share",
        F.coalesce(tokens / F.when(F.col("total") > 0, F.col("total")), F.lit(0.0)).alias("reached_share"),
        F.coalesce(tokens / F.when(F.sum(tokens).over(Window.partitionBy()) > 0, F.sum(tokens).over(Window.partitionBy())), F.lit(0.0)).alias("share_of_mix"),
        tokens.alias("tokens"),
        F.coalesce("uses", F.lit(0)).alias("uses"),
        "documents",
        F.coalesce("max_uses", F.lit(0)).alias("max_uses"),
        "max_repeats",
    )


def piecewise_schedule(spark: SparkSession, knots: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """A schedule from ``{source: [(time, weight), ...]}``; between knots the weight runs linearly."""
    rows = [(source, float(t), float(w)) for source, pairs in knots.items() for t, w in pairs]
    return spark.createDataFrame(rows, "source string, t double, weight double")
