"""Exact firing order of windows with allowed lateness.

A window fires when the watermark reaches its end, then once per micro-batch that brings late
events, and drops events once the watermark reaches its end plus the lateness. Built-in
aggregation cannot both fire at the end and keep state beyond it.

State is keyed by (zone, window), not by zone: windows are independent, so a hot zone is spread
over its windows. Before the shuffle each task reduces its events to one row per zone and window,
so that a key receives one partial count per task and never single events.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ridetide.functions.instants import window_start_ms
from ridetide.operators.windows import is_demand, is_supply

# The functions below run in Python workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_KEYS = ["zone_id", "window_start"]
_COUNTS = ["demand", "supply", "events"]
_PARTIAL = "zone_id INT, window_start BIGINT, demand BIGINT, supply BIGINT, events BIGINT"
_FIRED = "zone_id INT, window_start BIGINT, window_end BIGINT, demand BIGINT, supply BIGINT, late BIGINT"


# A task adds up its events whenever it holds this many rows, and passes the sums on when they are
# still more than half of that. This bounds its memory, not the result.
_HELD_ROWS = 200_000


def _sums(tables: list[pa.Table]) -> pa.Table:
    rows = pa.concat_tables(tables, promote_options="default")
    summed = rows.group_by(_KEYS).aggregate([(name, "sum") for name in _COUNTS])
    return summed.select([*_KEYS, *[f"{name}_sum" for name in _COUNTS]]).rename_columns(rows.schema.names)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < _HELD_ROWS:
            continue
        sums = _sums(held)
        if sums.num_rows > _HELD_ROWS // 2:
            yield from sums.to_batches()
            held, rows = [], 0
        else:
            held, rows = [sums], sums.num_rows
    if held:
        yield from _sums(held).to_batches()


class _WindowFiring(StatefulProcessor):
    """State of one (zone, window): counts, and whether the window has fired on time."""

    def __init__(self, window_ms: int, lateness_ms: int) -> None:
        self._window_ms = window_ms
        self._lateness_ms = lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._counts = handle.getValueState("counts", "demand BIGINT, supply BIGINT, fired BOOLEAN")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        zone, start = key
        end = start + self._window_ms
        watermark = timerValues.getCurrentWatermarkInMs()
        if end + self._lateness_ms <= watermark:
            late = sum(row.events for row in rows)
            yield Row(zone_id=zone, window_start=start, window_end=end, demand=0, supply=0, late=late)
            return
        held = self._counts.get()
        demand, supply, fired = held or (0, 0, False)
        for row in rows:
            demand += row.demand
            supply += row.supply
        fire = end <= watermark
        self._counts.update((demand, supply, fired or fire))
        if held is None:
            # A timer runs once the watermark is greater than its time; one at a time.
            self._handle.registerTimer((end + self._lateness_ms if fire else end) - 1)
        if fire:
            yield Row(zone_id=zone, window_start=start, window_end=end, demand=demand, supply=supply, late=0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._counts.get()
        if held is None:
            return
        zone, start = key
        end = start + self._window_ms
        demand, supply, fired = held
        if end + self._lateness_ms <= timerValues.getCurrentWatermarkInMs():
            self._counts.clear()
        else:
            self._counts.update((demand, supply, True))
            self._handle.registerTimer(end + self._lateness_ms - 1)
        if not fired:
            yield Row(zone_id=zone, window_start=start, window_end=end, demand=demand, supply=supply, late=0)

    def close(self) -> None:
        pass


def price_windows_exact(events: DataFrame, window_ms: int, lateness_ms: int) -> DataFrame:
    """(zone_id, window_start, window_end, demand, supply, late) in firing order.

    A row with ``late`` above 0 is no firing: it says how many events of a micro-batch came after the window was
    given up.

    ``events`` is a streaming frame whose watermark delay is the out-of-orderness alone. The
    session that starts the query needs ``ridetide.session.STREAM_CONF``. Use output mode update.
    """
    flags = events.select(
        "zone_id",
        window_start_ms(F.col("ts_event"), window_ms).alias("window_start"),
        is_demand().cast("bigint").alias("demand"),
        is_supply().cast("bigint").alias("supply"),
        F.lit(1).cast("bigint").alias("events"),
    )
    return (
        flags.mapInArrow(_add_up, _PARTIAL)
        .groupBy(*_KEYS)
        .transformWithState(_WindowFiring(window_ms, lateness_ms), _FIRED, "update", "eventTime")
    )
