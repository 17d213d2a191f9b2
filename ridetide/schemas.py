"""Fixed schemas of the streams and tables. Nothing is inferred at run time.

Counts are BIGINT: a busy zone in a long window can exceed 32 bits on large inputs.
"""


def column_names(ddl: str) -> tuple[str, ...]:
    """Names of a flat DDL text; commas inside DECIMAL(p,s) are not followed by a blank."""
    return tuple(column.split()[0] for column in ddl.split(", "))


NORMALIZED_EVENT = "kind STRING, zone_id INT, ts_event BIGINT, status STRING"

# Fields of a price update on the wire.
PRICE_UPDATE = (
    "zone_id INT, window_start BIGINT, window_end BIGINT, demand BIGINT, supply BIGINT, "
    "ratio DOUBLE, surge_multiplier DOUBLE, ts_compute BIGINT"
)
PRICE_UPDATE_FIELDS = column_names(PRICE_UPDATE)

# Columns of the stored tables. The ratio holds any two 64-bit counts.
ZONE_WINDOW_METRICS = (
    "zone_id INT, window_start TIMESTAMP, window_end TIMESTAMP, demand BIGINT, supply BIGINT, "
    "ratio DECIMAL(24,4), surge_multiplier DECIMAL(4,2), ts_compute TIMESTAMP"
)

ZONE_PRICE_SNAPSHOT = (
    "zone_id INT, surge_multiplier DECIMAL(4,2), demand BIGINT, supply BIGINT, "
    "ratio DECIMAL(24,4), window_start TIMESTAMP, window_end TIMESTAMP, updated_at TIMESTAMP"
)

FARE_CONFIG = (
    "zone_id INT, base_fare DECIMAL(8,2), distance_rate DECIMAL(6,2), time_rate DECIMAL(6,2), "
    "minimum_fare DECIMAL(8,2), zone_type STRING, active BOOLEAN, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)

QUOTE_REQUEST = (
    "origin_zone_id INT, destination_zone_id INT, estimated_distance_km DOUBLE, "
    "estimated_duration_min DOUBLE, ts BIGINT"
)

# One row per received price update; see streaming/store.py.
UPDATE_LOG = ZONE_WINDOW_METRICS + ", seq BIGINT, received_at TIMESTAMP"
