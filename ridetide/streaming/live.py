"""Live tables kept as state: the current price of a zone, its recent windows, and statistics of the fleet.

Each is a stateful step over a stream of price updates. What it holds can be read as a table from its
checkpoint (``state_table``), also after the job has stopped.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ridetide.functions.instants import RATIO_TYPE, SURGE_TYPE, from_millis, table_decimal
from ridetide.operators.history import RECENT_WINDOWS
from ridetide.operators.latest import SNAPSHOT_COLUMNS
from ridetide.operators.lookup import zone_row
from ridetide.operators.pricing import FARE_FIELDS, PRICE_FIELDS, answered
from ridetide.operators.stats import BUCKETS_BELOW, LAST_BUCKET, NORMAL, metrics_of_totals
from ridetide.operators.validate import valid_quotes
from ridetide.params import QUOTE_ZONES

# The functions below run in Python workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PRICE = "window_start BIGINT, window_end BIGINT, demand BIGINT, supply BIGINT, ratio DOUBLE, surge_multiplier DOUBLE"
_PRICE_FIELDS = ("window_start", "window_end", "demand", "supply", "ratio", "surge_multiplier")

# A zone's price is held in so many copies, and its requests are dealt among them: one zone may get a third
# of all requests, but never a third of them in one task.
COPIES = 8


def state_table(spark: SparkSession, checkpoint: str, variable: str, batch_id: int | None = None) -> DataFrame:
    """What a stateful step holds in a checkpoint, after its last or a given micro-batch: key and value."""
    reader = spark.read.format("statestore").option("stateVarName", variable)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    return reader.load(checkpoint)


def newest_of_tasks(updates: DataFrame, order: tuple[str, ...], most: int = 1) -> DataFrame:
    """Of the rows that a task has of a zone, those that a step may keep: the ``most`` greatest values of the
    first column of ``order``, each in the row that is greatest in the others.

    A zone may get a third of all rows, and a step takes its zones row by row in Python: so what reaches it is
    bounded by zones and tasks. ``order`` are whole numbers; nulls are least.
    """

    def newest(rows: pa.Table) -> pa.Table:
        zone = rows["zone_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        keys = [pc.fill_null(rows[name], np.iinfo(np.int64).min).to_numpy() for name in order]
        by_age = np.lexsort((*reversed(keys), zone))[::-1]
        zone, first = zone[by_age], keys[0][by_age]
        new_zone = np.r_[True, zone[1:] != zone[:-1]]
        new = new_zone | np.r_[True, first[1:] != first[:-1]]
        nth = np.cumsum(new)
        before = (nth - 1)[new_zone][np.cumsum(new_zone) - 1]
        return rows.take(by_age[new & (nth - before <= most)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                held = newest(rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    return updates.mapInArrow(run, updates.schema)


# The snapshot


class _LatestRow(StatefulProcessor):
    """State of a zone: its current row, which may be a seed row at first."""

    def __init__(self, fields: tuple[str, ...], schema: str, by_event_time: bool) -> None:
        self._fields = fields
        self._schema = schema
        self._by_event_time = by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._row = handle.getValueState("row", self._schema)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._row.update(tuple(initialState[name] for name in self._fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        start = self._fields.index("window_start")

        def order(row: tuple) -> tuple:
            # The position in the stream is the last field.
            return (row[start],) if self._by_event_time else (row[-1], row[start])

        arrived = (tuple(row[name] for name in self._fields) for row in rows)
        newest = max(arrived, key=lambda row: (*order(row), row[-1]))
        held = self._row.get()
        if self._by_event_time and held is not None and order(tuple(held)) > order(newest):
            return
        self._row.update(newest)
        yield Row(zone_id=key[0], **dict(zip(self._fields, newest, strict=True)))

    def close(self) -> None:
        pass


_SNAPSHOT = f"{_PRICE}, updated_at BIGINT, seq BIGINT"
_SNAPSHOT_FIELDS = (*_PRICE_FIELDS, "updated_at", "seq")


def snapshot_stream(updates: DataFrame, seed: DataFrame, by_event_time: bool = False) -> DataFrame:
    """Changes of the snapshot that begins with the seed rows, in wire types. Use output mode update.

    ``updates`` are wire updates with ``updated_at``, in milliseconds, and ``seq``. The last arrival wins, or the
    newest window, of one window the last. Of one micro-batch a zone gives one change.
    """
    wire = seed.select(
        "zone_id",
        *[F.unix_millis(name).alias(name) for name in ("window_start", "window_end", "updated_at")],
        "demand",
        "supply",
        *[F.col(name).cast("double").alias(name) for name in ("ratio", "surge_multiplier")],
        F.lit(-1).cast("bigint").alias("seq"),
    )
    processor = _LatestRow(_SNAPSHOT_FIELDS, _SNAPSHOT, by_event_time)
    order = ("window_start", "seq") if by_event_time else ("seq", "window_start")
    arrived = newest_of_tasks(updates.select("zone_id", *_SNAPSHOT_FIELDS), order)
    return arrived.groupBy("zone_id").transformWithState(
        processor, f"zone_id INT, {_SNAPSHOT}", "update", "none", wire.groupBy("zone_id")
    )


def snapshot_table(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """The snapshot that ``snapshot_stream`` holds: seed rows of zones without an update included."""
    rows = state_table(spark, checkpoint, "row", batch_id).select("key.zone_id", "value.*")
    return _typed(rows).select(*SNAPSHOT_COLUMNS)


def _typed(rows: DataFrame) -> DataFrame:
    """Wire columns in the types of the tables."""
    times = [name for name in ("window_start", "window_end", "updated_at") if name in rows.columns]
    return rows.withColumns(
        {
            **{name: from_millis(F.col(name)) for name in times},
            "ratio": table_decimal(F.col("ratio"), RATIO_TYPE),
            "surge_multiplier": table_decimal(F.col("surge_multiplier"), SURGE_TYPE),
        }
    )


# Quotes


class _CurrentPrice(StatefulProcessor):
    """State of a copy of a zone: its newest price. Requests get it, or a newer one of their own micro-batch."""

    def __init__(self, fields: tuple[str, ...], schema: str, asked: tuple[str, ...]) -> None:
        self._fields = fields
        self._schema = schema
        self._asked = asked

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._price = handle.getValueState("price", self._schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        requests, prices = [], []
        # What one micro-batch brings for a copy; the source's limits bound it.
        for row in rows:
            (prices if row["is_price"] else requests).append(row)
        known = sorted(((row["at"], *(row[name] for name in self._fields)) for row in prices), reverse=True)
        held = self._price.get()
        current = None if held is None else tuple(held)
        for request in sorted(requests, key=lambda row: row["at"]):
            while known and known[-1][0] <= request["at"]:
                newer = known.pop()
                current = newer if current is None or newer[0] >= current[0] else current
            values = (None,) * len(self._fields) if current is None else current[1:]
            yield Row(
                zone_id=key[0],
                at=request["at"],
                **{name: request[name] for name in self._asked},
                **dict(zip(self._fields, values, strict=True)),
            )
        latest = max([price for price in (current, *known) if price is not None], default=None)
        if prices and latest is not None:
            self._price.update(latest)

    def close(self) -> None:
        pass


_ESTIMATES = ("estimated_distance_km", "estimated_duration_min")
_QUOTED = "demand BIGINT, supply BIGINT, ratio DOUBLE, surge_multiplier DOUBLE"
_QUOTED_FIELDS = ("demand", "supply", "ratio", "surge_multiplier")


def live_quotes(
    requests: DataFrame, updates: DataFrame, fares: DataFrame, carry: tuple[str, ...] = ("request_id",), copies: int = COPIES
) -> DataFrame:
    """Quotes of a stream of requests by the price that a stream of wire updates has made current.

    A request gets the newest price, by ``ts_compute``, that arrived in a micro-batch before it, or in its own one
    if it was computed at the request's ``ts`` or before. Nothing waits: a request that comes before any price of
    its zone is quoted at surge 1. Every price goes to all copies of its zone, every request to one of them by
    its ``carry`` columns and time. Use output mode update.
    """
    kinds = {field.name: field.dataType.simpleString() for field in requests.schema.fields}
    dealt = F.pmod(F.xxhash64(*carry, "ts"), F.lit(copies)).cast("int")
    asked = valid_quotes(requests).select(
        F.col("origin_zone_id").alias("zone_id"),
        dealt.alias("copy"),
        F.lit(False).alias("is_price"),
        F.coalesce("ts", F.lit(0)).alias("at"),
        *carry,
        *_ESTIMATES,
    )
    known = updates.select(
        "zone_id",
        F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"),
        F.lit(True).alias("is_price"),
        F.col("ts_compute").alias("at"),
        *_QUOTED_FIELDS,
    )
    out = ", ".join(f"{name} {kinds[name]}" for name in (*carry, *_ESTIMATES))
    priced = (
        asked.unionByName(known, allowMissingColumns=True)
        .groupBy("zone_id", "copy")
        .transformWithState(
            _CurrentPrice(_QUOTED_FIELDS, f"at BIGINT, {_QUOTED}", (*carry, *_ESTIMATES)),
            f"zone_id INT, at BIGINT, {out}, {_QUOTED}",
            "update",
            "none",
        )
    )
    snap = F.struct(*[F.col(name) for name in PRICE_FIELDS])
    found = _typed(priced).withColumn("snap", F.when(F.col("surge_multiplier").isNotNull(), snap)).drop(*_QUOTED_FIELDS)
    fare = zone_row(fares.select("zone_id", *FARE_FIELDS, "updated_at"), QUOTE_ZONES, "updated_at", "fare", "zone_id")
    return answered(found.join(fare, "zone_id", "left"), from_millis(F.col("at")), carry)


# Recent windows


class _RecentWindows(StatefulProcessor):
    """State of a zone: its newest windows, a bounded number, each in its last version."""

    def __init__(self, fields: tuple[str, ...], schema: str, most: int) -> None:
        self._fields = fields
        self._schema = schema
        self._most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._windows = handle.getMapState("windows", "window_start BIGINT", self._schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived: dict[int, tuple] = {}
        for row in rows:
            version = tuple(row[name] for name in self._fields)
            held = arrived.get(row["window_start"])
            if held is None or version[-1] >= held[-1]:
                arrived[row["window_start"]] = version
        starts = {held[0] for held in self._windows.keys()}
        kept = sorted(starts | set(arrived))[-self._most :]
        for start in starts - set(kept):
            self._windows.removeKey((start,))
        for start in sorted(set(arrived) & set(kept)):
            version = arrived[start]
            if start in starts and tuple(self._windows.getValue((start,)))[-1] > version[-1]:
                continue
            self._windows.updateValue((start,), version)
            yield Row(zone_id=key[0], window_start=start, **dict(zip(self._fields, version, strict=True)))

    def close(self) -> None:
        pass


_WINDOW = "window_end BIGINT, demand BIGINT, supply BIGINT, ratio DOUBLE, surge_multiplier DOUBLE, ts_compute BIGINT, seq BIGINT"
_WINDOW_FIELDS = ("window_end", "demand", "supply", "ratio", "surge_multiplier", "ts_compute", "seq")


def recent_stream(updates: DataFrame, most: int = RECENT_WINDOWS) -> DataFrame:
    """Changes of the newest windows of each zone, in wire types. Use output mode update.

    A window that fires again replaces its row, whichever of them arrives first; ``seq`` says which is later. A
    window older than all that are kept, when as many are kept as may be, changes nothing.
    """
    processor = _RecentWindows(_WINDOW_FIELDS, _WINDOW, most)
    out = f"zone_id INT, window_start BIGINT, {_WINDOW}"
    arrived = newest_of_tasks(updates.select("zone_id", "window_start", *_WINDOW_FIELDS), ("window_start", "seq"), most)
    return arrived.groupBy("zone_id").transformWithState(processor, out, "update", "none")


def recent_table(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows that ``recent_stream`` holds, in wire types."""
    state = state_table(spark, checkpoint, "windows")
    return state.select("key.zone_id", "user_map_key.window_start", "user_map_value.*").drop("seq")


# Statistics


class _ZoneChanges(StatefulProcessor):
    """State of a zone: what it adds to the statistics. A change takes that back and adds the new values."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getValueState("held", "window_start BIGINT, cents BIGINT, demand BIGINT, supply BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max((row["window_start"], row["seq"], row["cents"], row["demand"], row["supply"]) for row in rows)
        values = newest[2:]
        held = self._held.get()
        if held is not None:
            if held[0] > newest[0]:
                return
            yield Row(fleet=0, zones=-1, cents=held[1], demand=-held[2], supply=-held[3])
        self._held.update((newest[0], *values))
        yield Row(fleet=0, zones=1, cents=values[0], demand=values[1], supply=values[2])

    def close(self) -> None:
        pass


class _FleetTotals(StatefulProcessor):
    """State of the fleet: sums over its zones, and how many zones have each surge."""

    def __init__(self, normal: tuple, below: tuple, last: str) -> None:
        self._normal = normal
        self._below = below
        self._last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._sums = handle.getValueState("sums", "zones BIGINT, cents BIGINT, demand BIGINT, supply BIGINT")
        self._surges = handle.getMapState("surges", "cents BIGINT", "zones BIGINT")

    def _bucket(self, cents: int) -> str:
        if cents == round(self._normal[1] * 100):
            return self._normal[0]
        return next((name for name, below in self._below if cents < round(below * 100)), self._last)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        sums = list(self._sums.get() or (0, 0, 0, 0))
        changed: dict[int, int] = {}
        for row in rows:
            for i, more in enumerate((row["zones"], row["zones"] * row["cents"], row["demand"], row["supply"])):
                sums[i] += more
            changed[row["cents"]] = changed.get(row["cents"], 0) + row["zones"]
        for cents, more in changed.items():
            held = self._surges.getValue((cents,)) if self._surges.containsKey((cents,)) else (0,)
            zones = held[0] + more
            if zones:
                self._surges.updateValue((cents,), (zones,))
            elif held[0]:
                self._surges.removeKey((cents,))
        self._sums.update(tuple(sums))
        # Surges have two decimals and an upper limit, so they are some hundreds at most.
        by_surge = {surge[0]: zones[0] for surge, zones in self._surges.iterator()}
        buckets = {name: 0 for name in (self._normal[0], *[name for name, _ in self._below], self._last)}
        for cents, zones in by_surge.items():
            buckets[self._bucket(cents)] += zones
        yield Row(
            active_zones=sums[0],
            surge_cents=sums[1],
            min_cents=min(by_surge),
            max_cents=max(by_surge),
            total_demand=sums[2],
            total_supply=sums[3],
            **buckets,
        )

    def close(self) -> None:
        pass


def fleet_stream(updates: DataFrame) -> DataFrame:
    """The statistics of ``stats.fleet_metrics`` after each micro-batch that changes them.

    ``updates`` are wire updates with ``seq``; the newest window of a zone counts. First a step per zone, which
    turns its change into what is taken back and what is added, then one for the fleet, which gets two rows
    per changed zone. Use output mode append.
    """
    cents = F.round(table_decimal(F.col("surge_multiplier"), SURGE_TYPE) * 100).cast("bigint")
    values = updates.select("zone_id", "window_start", "seq", cents.alias("cents"), "demand", "supply")
    changes = (
        newest_of_tasks(values, ("window_start", "seq", "cents", "demand", "supply"))
        .groupBy("zone_id")
        .transformWithState(
            _ZoneChanges(), "fleet INT, zones BIGINT, cents BIGINT, demand BIGINT, supply BIGINT", "append", "none"
        )
    )
    buckets = (NORMAL[0], *[name for name, _ in BUCKETS_BELOW], LAST_BUCKET)
    out = "active_zones BIGINT, surge_cents BIGINT, min_cents BIGINT, max_cents BIGINT, total_demand BIGINT, total_supply BIGINT"
    totals = changes.groupBy("fleet").transformWithState(
        _FleetTotals(NORMAL, BUCKETS_BELOW, LAST_BUCKET),
        out + "".join(f", {name} BIGINT" for name in buckets),
        "append",
        "none",
    )

    def surge(name: str) -> Column:
        return (F.col(name).cast("decimal(38,2)") / 100).cast("decimal(38,2)")

    return metrics_of_totals(
        totals.select(
            "active_zones",
            F.col("active_zones").alias("total_snapshots"),
            surge("surge_cents").cast("double").alias("__surge"),
            surge("min_cents").cast("double").alias("min_surge"),
            surge("max_cents").cast("double").alias("max_surge"),
            "total_demand",
            "total_supply",
            *buckets,
        )
    )
