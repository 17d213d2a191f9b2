"""Events -> demand and supply per zone and window -> price updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridetide.functions.curve import demand_supply_ratio, surge_multiplier
from ridetide.functions.instants import to_millis, window_start_ms
from ridetide.operators.normalize import AVAILABLE, HEARTBEAT, RIDE
from ridetide.schemas import PRICE_UPDATE_FIELDS


def is_demand():
    return F.col("kind") == RIDE


def is_supply():
    """Available heartbeats, not distinct drivers; case-sensitive, false where status is null."""
    available = (F.col("kind") == HEARTBEAT) & (F.col("status") == AVAILABLE)
    return F.coalesce(available, F.lit(False))


def zone_demand_supply(events: DataFrame, window_ms: int) -> DataFrame:
    """Counts per zone and epoch-aligned tumbling window, bounds in epoch milliseconds.

    Every event opens its group, so a window with busy drivers only gives (0, 0); windows without
    events give no row. Counts combine on the map side, so a hot zone reaches the shuffle as one
    row per task and window.

    A streaming frame needs a watermarked ``event_time``. A batch frame groups by whole numbers:
    the shortest grouping key.
    """
    counts = (
        F.count_if(is_demand()).alias("demand"),
        F.count_if(is_supply()).alias("supply"),
    )
    if events.isStreaming:
        grouped = events.groupBy(
            "zone_id", F.window("event_time", f"{window_ms} milliseconds").alias("w")
        ).agg(*counts)
        return grouped.select(
            "zone_id",
            to_millis(F.col("w.start")).alias("window_start"),
            to_millis(F.col("w.end")).alias("window_end"),
            "demand",
            "supply",
        )
    grouped = events.groupBy(
        "zone_id", window_start_ms(F.col("ts_event"), window_ms).alias("window_start")
    ).agg(*counts)
    return grouped.select(
        "zone_id",
        "window_start",
        (F.col("window_start") + F.lit(window_ms)).alias("window_end"),
        "demand",
        "supply",
    )


def to_price_updates(counts: DataFrame) -> DataFrame:
    """Add ratio, surge and the compute time, which is the window end and no clock."""
    return (
        counts.withColumn("ratio", demand_supply_ratio(F.col("demand"), F.col("supply")))
        .withColumn("surge_multiplier", surge_multiplier(F.col("ratio")))
        .withColumn("ts_compute", F.col("window_end"))
        .select(*PRICE_UPDATE_FIELDS)
    )


def price_updates(events: DataFrame, window_ms: int) -> DataFrame:
    return to_price_updates(zone_demand_supply(events, window_ms))
