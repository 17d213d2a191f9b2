"""Fleet statistics over the snapshot table: one aggregate each, no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the message of an empty table.
NO_DATA = "No data available yet"

# Bucket name and the surge below which it ends; "normal" is exactly 1.
NORMAL = ("normal", 1.0)
BUCKETS_BELOW = (("low", 1.5), ("medium", 2.0), ("high", 2.5))
LAST_BUCKET = "extreme"


def surge_bucket(surge: Column) -> Column:
    name = F.when(surge == F.lit(NORMAL[1]), F.lit(NORMAL[0]))
    for bucket, below in BUCKETS_BELOW:
        name = name.when(surge < F.lit(below), F.lit(bucket))
    return name.otherwise(F.lit(LAST_BUCKET))


def _bucket_names() -> tuple[str, ...]:
    return (NORMAL[0], *[name for name, _ in BUCKETS_BELOW], LAST_BUCKET)


def _distribution(snapshot: DataFrame) -> list[Column]:
    bucket = surge_bucket(F.col("surge_multiplier").cast("double"))
    return [F.count_if(bucket == name).alias(name) for name in _bucket_names()]


def surge_histogram(snapshot: DataFrame) -> DataFrame:
    """Zones per surge bucket; all five buckets are always present."""
    counts = snapshot.agg(*_distribution(snapshot))
    entries = [F.struct(F.lit(name).alias("bucket"), F.col(name).alias("zones")) for name in _bucket_names()]
    return counts.select(F.inline(F.array(*entries)))


def fleet_metrics(snapshot: DataFrame) -> DataFrame:
    """One row. The average ratio is total demand over total supply, not a mean of ratios.

    Surge is summed as a decimal, so the average does not depend on row order.
    """
    surge = F.col("surge_multiplier")
    totals = snapshot.agg(
        F.count_distinct("zone_id").alias("active_zones"),
        F.count(F.lit(1)).alias("total_snapshots"),
        F.sum(surge).cast("double").alias("__surge"),
        F.min(surge).cast("double").alias("min_surge"),
        F.max(surge).cast("double").alias("max_surge"),
        F.coalesce(F.sum("demand"), F.lit(0)).cast("bigint").alias("total_demand"),
        F.coalesce(F.sum("supply"), F.lit(0)).cast("bigint").alias("total_supply"),
        *_distribution(snapshot),
    )
    return metrics_of_totals(totals)


def metrics_of_totals(totals: DataFrame) -> DataFrame:
    """The statistics from counts, sums and extremes; ``__surge`` is the sum of surges."""
    demand, supply = F.col("total_demand").cast("double"), F.col("total_supply").cast("double")
    names = _bucket_names()
    return totals.select(
        F.when(F.col("total_snapshots") == 0, F.lit(NO_DATA)).alias("message"),
        "active_zones",
        "total_snapshots",
        F.when(F.col("total_snapshots") > 0, F.col("__surge") / F.col("total_snapshots")).alias("average_surge"),
        "min_surge",
        "max_surge",
        "total_demand",
        "total_supply",
        F.when(supply > 0, demand / supply).otherwise(F.lit(0.0)).alias("average_ratio"),
        F.create_map(*[part for name in names for part in (F.lit(name), F.col(name))]).alias("surge_distribution"),
    )
