"""The state machine of jobs, kept by key in a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.streaming.ingest import FINAL

OUT = "job_id string, status string, events long"
STATE = "status string, events long"
_NEXT = {None: {"QUEUED", "RUNNING", *FINAL}, "QUEUED": {"RUNNING", *FINAL}, "RUNNING": set(FINAL)}


def step(status: str | None, event: str) -> str | None:
    """The state after an event; events that cannot follow change nothing."""
    return event if event in _NEXT.get(status, ()) else status


def job_states(events: DataFrame) -> DataFrame:
    """A stream of job_id, at, status -> each job's state after every batch in which it has events. A job's events are
    taken one by one in the order of their time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else (None, 0)
        pdf = pd.concat(batches).sort_values("at", kind="stable")
        for e in pdf.status:
            status, n = step(status, e), n + 1
        state.update((status, n))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "events": [n]})

    return events.groupBy("job_id").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
