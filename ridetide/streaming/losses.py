"""What the jobs leave out, counted over all their micro-batches."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

LATE_METRIC = "late"


class Losses(StreamingQueryListener):
    """Sums of the observed metrics of every query of a session, and of rows dropped by the watermark.

    A progress event of a query tells of one micro-batch. Spark keeps the last hundred of them; here all
    are added up as they come. A micro-batch that is repeated after a failure replaces what it told before,
    and since each query has one micro-batch at a time, only its last one is held apart from the sums.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._changed = threading.Condition()
        self._sums: dict[str, dict[str, dict[str, int]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
        self._last: dict[str, tuple[int, dict[str, dict[str, int]]]] = {}
        self._ended: set[str] = set()

    def __enter__(self) -> Losses:
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self._spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        told = {name: {k: v or 0 for k, v in row.asDict().items()} for name, row in progress.observedMetrics.items()}
        told["watermark"] = {"rows": sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)}
        with self._changed:
            self._put(str(progress.id), progress.batchId, told)

    def _put(self, query: str, batch: int, told: dict[str, dict[str, int]]) -> None:
        before, held = self._last.get(query, (-1, {}))
        if batch < before:
            return
        if batch > before:
            for name, values in held.items():
                for key, value in values.items():
                    self._sums[query][name][key] += value
        elif not any(value for values in told.values() for value in values.values()):
            return  # an idle trigger tells of the last micro-batch again, without its numbers
        self._last[query] = batch, told

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def of(self, query: StreamingQuery, timeout_s: float = 60.0) -> dict[str, dict[str, int]]:
        """Metric -> name -> sum, over all runs of the query; of one that has ended, with its last event.

        ``watermark`` has ``rows``: what a built-in aggregate dropped, a row per task, zone and window.
        """
        with self._changed:
            if not query.isActive:
                self._changed.wait_for(lambda: str(query.runId) in self._ended, timeout_s)
            totals = {name: dict(values) for name, values in self._sums[str(query.id)].items()}
            for name, values in self._last.get(str(query.id), (-1, {}))[1].items():
                held = totals.setdefault(name, {})
                for key, value in values.items():
                    held[key] = held.get(key, 0) + value
            return totals
