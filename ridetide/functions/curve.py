"""Demand/supply ratio and the piecewise-linear surge curve, in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ratio of a window with demand and no supply, and without either.
RATIO_NO_SUPPLY = 999.0
RATIO_IDLE = 0.0

# The surge curve. No surge up to the first ratio; then one line per segment,
# (ratio where it ends, inclusive; ratio where it starts; surge where it starts; slope).
# The last segment has no end and is capped.
SURGE_NONE = 1.0
SURGE_NONE_UP_TO = 0.5
SURGE_SEGMENTS = (
    (0.8, 0.5, 1.0, 1.0),
    (1.2, 0.8, 1.3, 1.75),
    (2.0, 1.2, 2.0, 2.5),
    (3.0, 2.0, 4.0, 1.5),
    (None, 3.0, 5.5, 0.75),
)
SURGE_CAP = 7.0


def demand_supply_ratio(demand: Column, supply: Column) -> Column:
    return (
        F.when(supply > 0, demand.cast("double") / supply.cast("double"))
        .when(demand > 0, F.lit(RATIO_NO_SUPPLY))
        .otherwise(F.lit(RATIO_IDLE))
    )


def surge_multiplier(ratio: Column) -> Column:
    surge = F.when(ratio <= F.lit(SURGE_NONE_UP_TO), F.lit(SURGE_NONE))
    for ends_at, starts_at, start, slope in SURGE_SEGMENTS:
        line = F.lit(start) + (ratio - F.lit(starts_at)) * F.lit(slope)
        if ends_at is None:
            return surge.otherwise(F.least(F.lit(SURGE_CAP), line))
        surge = surge.when(ratio <= F.lit(ends_at), line)
    return surge
