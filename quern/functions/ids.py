"""Identifiers from an injected clock and a seed, so that the same input gives the same id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minted_id(at: Column, seed: Column) -> Column:
    """An id in the form of UUIDv7: the milliseconds of ``at`` first, then bits of the hash of ``seed``. Null for a null seed."""
    time = F.lpad(F.lower(F.hex(F.unix_millis(at.cast("timestamp")))), 12, "0")
    bits = F.sha2(seed, 256)
    return F.concat(F.left(time, F.lit(8)), F.lit("-"), F.substring(time, 9, 4), F.lit("-7"), F.substring(bits, 1, 3), F.lit("-8"), F.substring(bits, 4, 3), F.lit("-"), F.substring(bits, 7, 12))
