"""The log pipeline as Structured Streaming: read, level, window, write."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions.text import level_of


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream over the parquet files at ``path``; ``files_per_batch`` is the back-pressure."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def leveled(lines: DataFrame, run_id: str | None = None) -> DataFrame:
    """Lines with the level their message tells, tagged with the run that writes them."""
    return lines.withColumns({"level": level_of(F.col("message")), "run_id": F.coalesce(F.col("run_id").cast("string"), F.lit(run_id))})


def windowed_counts(lines: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """(start, level, n) for each window, lines later than ``late`` left out."""
    stamped = lines.withWatermark("created_at", late)
    counted = stamped.groupBy(F.window("created_at", width).alias("w"), "level").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "level", "n")


def sessions(lines: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(run_id, start, end, n): bursts of lines of one run with no pause longer than ``gap``."""
    stamped = lines.withWatermark("created_at", late)
    counted = stamped.groupBy(F.session_window("created_at", gap).alias("w"), "run_id").agg(F.count("*").alias("n"))
    return counted.select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """Lines that were delivered again within ``late`` count once."""
    return lines.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", trigger: timedelta | None = None) -> StreamingQuery:
    """Write all there is of ``stream`` as parquet to ``target``, or go on every ``trigger``; the query can be stopped and awaited."""
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    if trigger is None:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    return writer.trigger(processingTime=f"{trigger.total_seconds()} seconds").start()
