"""The pricing job: two raw streams -> price updates."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ridetide.functions.instants import to_millis
from ridetide.operators.normalize import (
    EVENT,
    HEARTBEAT,
    JUDGED,
    REFUSED,
    RIDE,
    judge,
    normalize,
    quarantine,
    union_events,
    with_event_time,
)
from ridetide.operators.windows import to_price_updates, zone_demand_supply
from ridetide.params import PricingParams
from ridetide.schemas import NORMALIZED_EVENT, column_names
from ridetide.session import STREAM_CONF, session_conf
from ridetide.streaming.exact import price_windows_exact
from ridetide.streaming.losses import LATE_METRIC

LIVE, FINAL, EXACT = "live", "final", "exact"
STRICT, UNION, TICKS = "strict", "union", "ticks"

# How long a stream may be silent before it holds nothing back, and restarts of a job.
IDLE_MS = 15_000
RESTARTS = 50

RIDES_METRIC, HEARTBEATS_METRIC = "rides", "heartbeats"
_TICK = "TICK"


class PriceStream(NamedTuple):
    updates: DataFrame
    output_mode: str


def watermarked_events(
    rides: DataFrame, heartbeats: DataFrame, delay_ms: int, idle_policy: str = STRICT
) -> DataFrame:
    """Union of the normalised streams, with event time and watermark.

    ``strict``: one watermark per stream, the slower one counts; a silent stream holds all windows
    back. ``union``: one watermark after the union; a silent stream holds nothing back, but a slow
    one loses its late events. ``ticks``: as ``strict``, but a stream that is silent for ``IDLE_MS``
    holds nothing back; for live data, whose event time follows the clock.
    """
    delay = f"{delay_ms} milliseconds"
    if idle_policy == TICKS:
        return union_events(*[_with_ticks(events, delay) for events in (rides, heartbeats)])
    rides, heartbeats = with_event_time(rides), with_event_time(heartbeats)
    if idle_policy == STRICT:
        return union_events(
            rides.withWatermark("event_time", delay), heartbeats.withWatermark("event_time", delay)
        )
    if idle_policy == UNION:
        return union_events(rides, heartbeats).withWatermark("event_time", delay)
    raise ValueError(f"unknown idle policy: {idle_policy}")


def _with_ticks(events: DataFrame, delay: str) -> DataFrame:
    """The events with a watermark that also follows the clock, ``IDLE_MS`` behind.

    A row per second carries that time through the watermark and is removed after it, by a generator,
    as a filter would be pushed below.
    """
    clock = events.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    ticks = clock.select(
        F.lit(_TICK).alias("kind"),
        F.lit(None).cast("int").alias("zone_id"),
        (F.unix_millis("timestamp") - F.lit(IDLE_MS)).alias("ts_event"),
        F.lit(None).cast("string").alias("status"),
    )
    marked = with_event_time(union_events(events, ticks)).withWatermark("event_time", delay)
    is_event = F.when(F.col("kind") != _TICK, F.array(F.lit(True)))
    return marked.select("*", F.explode(is_event).alias("__event")).drop("__event")


def price_stream(
    rides: DataFrame,
    heartbeats: DataFrame,
    params: PricingParams = PricingParams(),
    mode: str = LIVE,
    idle_policy: str = STRICT,
) -> PriceStream:
    """Price updates of normalised streams.

    ``live``: a row whenever counts change, until the window is past its lateness; converges.
    ``final``: one row per window, when it is past its lateness.
    ``exact``: on time, then one row per late micro-batch; see ``streaming/exact.py``. Events that come too late
    are counted as the observed metric ``late``.
    """
    if mode == EXACT:
        events = watermarked_events(rides, heartbeats, params.out_of_orderness_ms, idle_policy)
        fired = price_windows_exact(events, params.window_ms, params.lateness_ms)
        told = fired.observe(LATE_METRIC, F.coalesce(F.sum("late"), F.lit(0)).alias("events"))
        return PriceStream(to_price_updates(told.where("late = 0")), "update")
    if mode not in (LIVE, FINAL):
        raise ValueError(f"unknown mode: {mode}")
    events = watermarked_events(rides, heartbeats, params.retention_ms, idle_policy)
    counts = zone_demand_supply(events, params.window_ms)
    return PriceStream(to_price_updates(counts), "update" if mode == LIVE else "append")


def price_stream_of_json(
    ride_requests: DataFrame,
    driver_heartbeats: DataFrame,
    params: PricingParams = PricingParams(),
    mode: str = LIVE,
    idle_policy: str = STRICT,
) -> PriceStream:
    """As ``price_stream``, from raw payloads; unusable ones are left out.

    Each payload is parsed once. The progress of the query has the payloads received and refused
    as observed metrics ``rides`` and ``heartbeats``, which ``losses.Losses`` adds up; ``refused_payloads`` and
    ``ingest`` keep the payloads themselves.
    """
    return price_stream(
        normalize(ride_requests, RIDE, counted=RIDES_METRIC),
        normalize(driver_heartbeats, HEARTBEAT, counted=HEARTBEATS_METRIC),
        params,
        mode,
        idle_policy,
    )


def open_windows(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """(zone_id, window_start, window_end, demand, supply) of the windows whose counts a job of a built-in mode
    holds, after its last or a given micro-batch; the job may run, be stopped or have failed."""
    reader = spark.read.format("statestore")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    state = reader.load(checkpoint)
    # By position: the planner names the counts, and both alike.
    key = F.col("key").cast("struct<zone_id: int, window: struct<start: timestamp, end: timestamp>>")
    counts = F.col("value").cast("struct<demand: bigint, supply: bigint>")
    return state.select(
        key["zone_id"].alias("zone_id"),
        to_millis(key["window"]["start"]).alias("window_start"),
        to_millis(key["window"]["end"]).alias("window_end"),
        counts["demand"].alias("demand"),
        counts["supply"].alias("supply"),
    )


def refused_payloads(ride_requests: DataFrame, driver_heartbeats: DataFrame) -> DataFrame:
    """(value, kind, reason) of the payloads that the job leaves out, for a quarantine of their own."""
    return union_events(
        *[
            quarantine(raw.select("value"), kind).withColumn("kind", F.lit(kind))
            for raw, kind in ((ride_requests, RIDE), (driver_heartbeats, HEARTBEAT))
        ]
    )


def ingest(raw: DataFrame, kind: str, folder: str) -> DataStreamWriter:
    """Writer that parses each payload of a stream once and stores it either as an event or as refused.

    One table, partitioned by kind and outcome, written by the file sink, which stores every micro-batch
    exactly once. ``events_of`` reads it on as a stream, ``refused_of`` as a table.
    """
    return (
        judge(raw, kind).writeStream.partitionBy("kind", "outcome").format("parquet").option("path", f"{folder}/{kind}")
    )


def events_of(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The normalised events that ``ingest`` stored, as a stream."""
    rows = spark.readStream.schema(JUDGED).parquet(f"{folder}/{kind}")
    return rows.where(F.col("outcome") == EVENT).select(*column_names(NORMALIZED_EVENT))


def refused_of(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(value, kind, reason) of the payloads that ``ingest`` refused."""
    rows = spark.read.schema(JUDGED).parquet(f"{folder}/{kind}")
    return rows.where(F.col("outcome") == REFUSED).select("value", "kind", "reason")


def supervise(
    spark: SparkSession,
    writer: DataStreamWriter,
    checkpoint: str,
    interval: str | None = None,
    restarts: int = RESTARTS,
    pause_s: float = 1.0,
) -> StreamingQuery:
    """Run a writer until it ends or is stopped; after a failure start it again from its checkpoint,
    at most ``restarts`` times, and then fail with the last error."""
    for attempt in range(restarts + 1):
        query = start(spark, writer, checkpoint, interval)
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException:
            if attempt == restarts:
                raise
            time.sleep(pause_s)


def start(
    spark: SparkSession,
    writer: DataStreamWriter,
    checkpoint: str,
    interval: str | None = None,
    name: str | None = None,
    settings: dict[str, str] | None = None,
) -> StreamingQuery:
    """Start a writer. Without an interval it processes what is available and ends. ``settings`` of the
    session hold for this query, above those that the jobs need.

    State, offsets and commits live in ``checkpoint``, which must be a shared folder: a restarted
    query goes on from its last committed micro-batch, also after a lost driver or executor.
    """
    if name:
        writer = writer.queryName(name)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    with session_conf(spark, STREAM_CONF | (settings or {})):
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
