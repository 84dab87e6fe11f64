"""Session helpers shared by every layer: reading tables, cutting lineage, checking sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_quern_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quern-package-")  # on the driver, which serves the file as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    copy = Path(folder, "source", package.name)
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(Path(folder, "quern")), "zip", copy.parent))
    context._quern_shipped = True


def read_table(spark: SparkSession, root: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """One table of a data directory, pruned to ``columns``; NTZ timestamps become UTC instants."""
    ship(spark)
    df = spark.read.parquet(f"{root}/{name}.parquet")
    if columns is not None:
        df = df.select(*columns)
    casts = {c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``; only where that is unset take one of our own, in local mode alone.

    On a cluster a folder of the driver's machine would be lost to the executors, so there it is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="quern-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``rows`` rows, else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def newest(df: DataFrame, key: str | list[str], order: str, *payload: str) -> DataFrame:
    """One row per ``key``: the values of ``payload`` in the row with the greatest ``order``.

    Partial aggregation runs before the shuffle, so a key that was delivered very often is not a hot key.
    Rows whose ``order`` is null lose against all others; null keys form one group.
    """
    keys = [key] if isinstance(key, str) else list(key)
    best = F.max_by(F.struct(*payload), F.coalesce(F.col(order).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*")


def current_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """``df`` without rows that a later delivery of the same ``key`` replaced; rows of equal ``order`` all stay.

    Only the keys and times are shuffled; the few replaced rows are broadcast where their number allows it.
    """
    last = df.groupBy(key).agg(F.max(order).alias("__last"), F.min(order).alias("__first")).where("__first < __last").select(F.col(key).alias("__key"), "__last")
    return df.join(if_small(last), F.col(key).eqNullSafe(F.col("__key")) & (F.col(order) < F.col("__last")), "left_anti")


def all_of(predicates: Iterable[Column | None]) -> Column:
    """Conjunction of the predicates that are given."""
    out = F.lit(True)
    for p in predicates:
        if p is not None:
            out = out & p
    return out
