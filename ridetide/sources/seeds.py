"""Illustrative first rows of the snapshot table."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridetide.functions.instants import instant
from ridetide.operators.latest import SNAPSHOT_COLUMNS

# Zone, surge, demand, supply, ratio. The windows started a minute ago and ended
# 46 seconds ago.
SEED_ROWS = (
    (1, "2.30", 28, 12, "2.33"),
    (3, "1.80", 18, 10, "1.80"),
    (6, "1.00", 8, 15, "0.53"),
    (8, "1.10", 12, 11, "1.09"),
    (10, "1.00", 5, 12, "0.42"),
    (12, "1.20", 8, 9, "0.89"),
    (14, "1.50", 15, 10, "1.50"),
    (16, "2.00", 22, 11, "2.00"),
)


def seed_snapshot(spark: SparkSession, as_of_ms: int | None = None) -> DataFrame:
    rows = [(z, Decimal(s), d, n, Decimal(r)) for z, s, d, n, r in SEED_ROWS]
    schema = (
        "zone_id INT, surge_multiplier DECIMAL(4,2), demand BIGINT, supply BIGINT, ratio DECIMAL(24,4)"
    )
    now = instant(as_of_ms)
    return (
        spark.createDataFrame(rows, schema)
        .withColumns(
            {
                "window_start": now - F.expr("INTERVAL 1 MINUTE"),
                "window_end": now - F.expr("INTERVAL 46 SECONDS"),
                "updated_at": now,
            }
        )
        .select(*SNAPSHOT_COLUMNS)
    )
