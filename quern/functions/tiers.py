"""Lifetime of cached rows: tiers, promotion, sliding expiry, freshness."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.config import TIERS, Tiers


def interval(length: timedelta) -> Column:
    return F.make_dt_interval(F.lit(length.days), F.lit(0), F.lit(0), F.lit(length.seconds + length.microseconds / 1e6))


def promoted(tier: Column, hits: Column, settings: Tiers) -> Column:
    """``short`` becomes ``long`` from enough hits on; nothing becomes permanent by itself."""
    return F.when((tier == "short") & (hits >= settings.promote_after_hits), "long").otherwise(tier)


def expiry(now: Column, tier: Column, settings: Tiers) -> Column:
    """Now plus the lifetime of the tier; null for permanent, an unknown or null tier counts as short."""
    return F.when(F.coalesce(tier, F.lit("")) == "permanent", None).when(tier == "long", now + interval(settings.long_ttl)).otherwise(now + interval(settings.short_ttl))


def normalized_tier(value: Column, default: Column) -> Column:
    """A known tier, in any case, else the default, else short."""
    clean = lambda c: F.lower(F.trim(c))
    return F.when(clean(value).isin(*TIERS), clean(value)).when(clean(default).isin(*TIERS), clean(default)).otherwise("short")


def remembered_tier(value: Column, default: str = "short") -> Column:
    """Tier to remember something with; null where the value says not to."""
    clean = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(clean.isin("off", "none", "no", "false"), None).otherwise(normalized_tier(value, F.lit(default)))


def fresh(now: Column, expires_at: Column, fetched_at: Column, max_age: Column | timedelta | None = None) -> Column:
    """Not expired, and fetched within ``max_age`` where that is given; a missing time never makes a row stale."""
    alive = expires_at.isNull() | (now <= expires_at)
    if max_age is None:
        return alive
    age = max_age if isinstance(max_age, Column) else interval(max_age)
    return alive & F.coalesce(fetched_at + age >= now, F.lit(True))


def volatility_hours(volatility: Column) -> Column:
    """Greatest age of a fact in hours; 0 for no limit."""
    return F.when(F.lower(F.trim(volatility)).isin("time-sensitive", "volatile", "time_sensitive"), 24).otherwise(0)


def recent_enough(now: Column, fetched_at: Column, volatility: Column) -> Column:
    """Whether a fact of this volatility is still young enough."""
    hours = volatility_hours(volatility)
    return (hours == 0) | F.coalesce(fetched_at + F.make_dt_interval(F.lit(0), hours) >= now, F.lit(True))
