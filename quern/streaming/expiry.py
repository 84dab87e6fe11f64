"""Sliding expiry over a stream of hits: per key a state that every hit renews and that time removes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.config import Tiers

_OUT = "key string, hits int, tier string, expired boolean, at timestamp"


def sliding_expiry(hits: DataFrame, settings: Tiers = Tiers(), late: str = "0 seconds") -> DataFrame:
    """Per key its hits, tier and whether it has expired, from a stream of (key, at).

    A key begins in the short tier, rises to long with enough hits and expires when no hit comes within the
    lifetime of its tier, measured in event time. The state of a key is one small tuple.
    """

    def update(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            count, tier, last = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "hits": [count], "tier": [tier], "expired": [True], "at": [pd.Timestamp(last, unit="ms")]})
            return
        count, tier, last = state.get if state.exists else (0, "short", 0)
        for batch in batches:
            count += len(batch)
            last = max(last, int(batch["at"].max().timestamp() * 1000))
        if tier == "short" and count >= settings.promote_after_hits:
            tier = "long"
        state.update((count, tier, last))
        life = settings.long_ttl if tier == "long" else settings.short_ttl
        state.setTimeoutTimestamp(max(last + int(life.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "hits": [count], "tier": [tier], "expired": [False], "at": [pd.Timestamp(last, unit="ms")]})

    return hits.withWatermark("at", late).groupBy("key").applyInPandasWithState(update, _OUT, "hits int, tier string, last long", "update", GroupStateTimeout.EventTimeTimeout)
