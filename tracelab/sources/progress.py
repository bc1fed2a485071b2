"""Counts and progress of running jobs: counts that a job makes as it runs, without a second pass, and a listener for streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Callable[[], dict[str, Any]]]:
    """df, and a function that gives the aggregates of its rows once an action over all of them has run; it waits for that."""
    seen = Observation()
    return df.observe(seen, *(c.alias(n) for n, c in counts.items())), lambda: seen.get


class StreamProgress(StreamingQueryListener):
    """Tells of every batch of every query: its name, batch, rows read so far, rows of state and, at its end, the error if there was one."""

    def __init__(self, tell: Callable[[dict[str, Any]], None]):
        self.tell, self.rows = tell, {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.runId)] = 0
        self.tell({"event": "started", "query": event.name})

    def onQueryProgress(self, event) -> None:
        p, run = event.progress, str(event.progress.runId)
        self.rows[run] = self.rows.get(run, 0) + p.numInputRows
        self.tell({"event": "batch", "query": p.name, "batch": p.batchId, "rows": self.rows[run], "state_rows": sum(s.numRowsTotal for s in p.stateOperators)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.rows.pop(str(event.runId), None)
        self.tell({"event": "ended", "error": event.exception})


@contextmanager
def streams_watched(spark: SparkSession, tell: Callable[[dict[str, Any]], None]) -> Iterator[None]:
    listener = StreamProgress(tell)
    spark.streams.addListener(listener)
    try:
        yield
    finally:
        spark.streams.removeListener(listener)
