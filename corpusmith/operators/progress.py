"""Progress without another pass: metrics that a job gathers while it runs."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Progress:
    """Rows, seconds and rows a second of one job. total: rows that are expected, if known."""

    def __init__(self, label: str, total: int | None = None) -> None:
        self.label, self.total = label, total
        self._observation, self._began = Observation(label), time.monotonic()

    def watch(self, df: DataFrame, **metrics: Column) -> DataFrame:
        """df, whose next action counts its rows and works out the metrics (aggregates) besides."""
        self._began = time.monotonic()
        return df.observe(self._observation, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in metrics.items()))

    def report(self) -> dict:
        """What was gathered; waits for the action. share: of the rows that were expected."""
        found = dict(self._observation.get)
        seconds = max(time.monotonic() - self._began, 1e-6)
        out = {"label": self.label, "seconds": seconds, "rows_per_second": found["rows"] / seconds, **found}
        return out | ({"share": found["rows"] / self.total} if self.total else {})


def seconds_left(done: int, total: int, seconds: float) -> float | None:
    """At the pace so far; None before anything is done."""
    return None if done <= 0 else seconds * max(0, total - done) / done


class StreamProgress(StreamingQueryListener):
    """The batches of the session's streams: (name, batch, rows, rows a second)."""

    def __init__(self) -> None:
        self.batches: list[tuple[str | None, int, int, float]] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802  (Spark's names)
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.batches.append((p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
