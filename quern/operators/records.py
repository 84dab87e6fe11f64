"""Tables as records: what was delivered more than once counts once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.runtime import newest, read_table

#: Key of each table; tables with updated_at count in their newest row.
KEYS = {"vectors": ("owner_kind", "id", "model")}
VERSIONED = ("scrape_cache", "memory_facts", "search_cache")


def records(spark: SparkSession, root: str, table: str, *columns: str | Column, where: Column | None = None) -> DataFrame:
    """The records of ``table`` with ``columns`` (names or expressions; the key is always there).

    Expressions are worked out before rows are deduplicated, so that a size is shuffled and not the text.
    ``where`` is applied even before that, so that it reaches the scan; it may only look at columns that do not
    change between the deliveries of a record, like its url or its run.
    """
    key = KEYS.get(table, ("id",))
    names = [c for c in columns if not (isinstance(c, str) and c in key)]
    rows = read_table(spark, root, table)
    if where is not None:
        rows = rows.where(where)
    if table in VERSIONED:
        shaped = rows.select(*key, F.col("updated_at").alias("__order"), *names)
        payload = [c for c in shaped.columns if c not in (*key, "__order")]
        if not payload:
            return shaped.select(*key).distinct()
        return newest(shaped, list(key), "__order", *payload)
    return rows.select(*key, *names).dropDuplicates(list(key))


def zero_filled(counts: DataFrame, column: str, domain: Sequence[str], count: str = "n") -> DataFrame:
    """Group counts with a row for every value of ``domain``; other values keep theirs."""
    values = counts.sparkSession.createDataFrame([(v,) for v in domain], f"`{column}` string")
    return values.join(counts, column, "full_outer").select(column, F.coalesce(count, F.lit(0)).alias(count))


def micros(column: str) -> Column:
    """A time as microseconds since 1970."""
    return F.unix_micros(F.col(column).cast("timestamp"))
