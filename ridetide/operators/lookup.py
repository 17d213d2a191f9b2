"""Zone-keyed lookup sides of a proven size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Above this many possible zones a lookup side is not forced to be broadcast: Spark then chooses
# the join, and adaptive execution splits skewed partitions of the request side.
BROADCAST_MAX_ZONES = 10_000


def zone_row(
    table: DataFrame, zones: tuple[int, int], newest: Column | str, name: str, key: str
) -> DataFrame:
    """(key, name STRUCT) with at most one row per zone of the range.

    The range and the aggregate bound the side to ``zones`` rows whatever the table holds, and a
    repeated table row cannot multiply requests.
    """
    low, high = zones
    rest = [column for column in table.columns if column != "zone_id"]
    side = (
        table.filter(F.col("zone_id").between(low, high))
        .groupBy(F.col("zone_id").alias(key))
        .agg(F.max_by(F.struct(*rest), newest).alias(name))
    )
    return F.broadcast(side) if high - low < BROADCAST_MAX_ZONES else side
