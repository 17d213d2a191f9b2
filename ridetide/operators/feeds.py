"""Change feeds: one JSON record per price update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridetide.functions.instants import instant, iso_text
from ridetide.operators.lookup import BROADCAST_MAX_ZONES
from ridetide.operators.validate import guard_zones
from ridetide.params import READ_ZONES


def _now_text(as_of_ms: int | None) -> Column:
    return iso_text(instant(as_of_ms))


def all_zones_feed(updates: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """Six fields for every update."""
    fields = F.struct(
        "zone_id",
        "surge_multiplier",
        "demand",
        "supply",
        "ratio",
        _now_text(as_of_ms).alias("updated_at"),
    )
    return updates.select("zone_id", F.to_json(fields).alias("value"))


def zone_feed(
    updates: DataFrame,
    subscriptions: DataFrame,
    as_of_ms: int | None = None,
    zones: tuple[int, int] = READ_ZONES,
) -> DataFrame:
    """Full price response, without a fare, for the updates of subscribed zones.

    Any number of subscriptions reduces to its distinct accepted zones, so the lookup side has at
    most as many rows as the range has zones.
    """
    accepted, _ = guard_zones(subscriptions, zones)
    wanted = accepted.select("zone_id").distinct()
    if zones[1] - zones[0] < BROADCAST_MAX_ZONES:
        wanted = F.broadcast(wanted)
    fields = F.struct(
        "zone_id",
        "surge_multiplier",
        F.lit(None).cast("double").alias("quoted_fare"),
        _now_text(as_of_ms).alias("updated_at"),
        "demand",
        "supply",
        "ratio",
    )
    body = F.to_json(fields, {"ignoreNullFields": "false"})
    return updates.join(wanted, "zone_id", "left_semi").select("zone_id", body.alias("value"))
