"""The job runner as a micro-batch loop: handlers by type over claimed jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.config import Jobs
from quern.operators.jobs import claimable, claimed, settled
from quern.runtime import cut

Handler = Callable[[str], None]


def outcomes(jobs: DataFrame, handlers: dict[str, Handler]) -> DataFrame:
    """(id, ok) of running each job's handler on its payload, on the workers; an unknown type fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for kind, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    handlers[kind](payload)
                    done.append(True)
                except Exception:  # noqa: BLE001 - whatever a handler raises is a failed attempt
                    done.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.bool_())], names=["id", "ok"])

    return jobs.select("id", "type", "payload").mapInArrow(run, "id string, ok boolean")


def step(jobs: DataFrame, handlers: dict[str, Handler], now: datetime, limit: int = 128, settings: Jobs = Jobs()) -> DataFrame:
    """The queue after one round: claim, run, settle. Each round is cut, so a lost executor runs no job twice."""
    taken = cut(claimable(jobs, now, limit))
    return cut(settled(claimed(jobs, now, limit), cut(outcomes(taken, handlers)), now, settings))
