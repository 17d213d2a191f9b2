"""Request checks. Each splits a frame by a ``reject_reason`` that is null for valid rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridetide.functions.fare import ESTIMATE_LIMIT
from ridetide.params import QUOTE_ZONES, READ_ZONES

REASON = "reject_reason"


def in_zones(zone: Column, zones: tuple[int, int]) -> Column:
    return F.coalesce(zone.between(*zones), F.lit(False))


def guard_zones(
    requests: DataFrame, zones: tuple[int, int] = READ_ZONES, zone: str = "zone_id"
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason) for price, history and feed requests."""
    accepted = requests.filter(F.col(zone).between(*zones))
    rejected = requests.filter(~in_zones(F.col(zone), zones)).withColumn(
        REASON, F.lit(f"{zone} not in {zones[0]}..{zones[1]}")
    )
    return accepted, rejected


def quote_reject_reason(zones: tuple[int, int] = QUOTE_ZONES) -> Column:
    reason = F.when(~in_zones(F.col("origin_zone_id"), zones), F.lit("origin_zone_id"))
    reason = reason.when(
        ~in_zones(F.col("destination_zone_id"), zones), F.lit("destination_zone_id")
    )
    for name in ("estimated_distance_km", "estimated_duration_min"):
        estimate = F.col(name)
        reason = reason.when(F.isnan(estimate) | (estimate < 0), F.lit(name))
        reason = reason.when(estimate >= F.lit(ESTIMATE_LIMIT), F.lit(f"{name} too large"))
    return reason


def valid_quotes(requests: DataFrame) -> DataFrame:
    return requests.filter(quote_reject_reason().isNull())


def rejected_quotes(requests: DataFrame) -> DataFrame:
    return requests.withColumn(REASON, quote_reject_reason()).filter(F.col(REASON).isNotNull())
