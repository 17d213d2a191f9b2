"""Fare table built from zone bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridetide.functions.instants import instant

# Fixed values: (first zone, last zone, type) and, per rate, (lowest value, width of the draw).
BANDS = (
    (1, 4, "DOWNTOWN", {"base_fare": ("8.00", "2.00"), "distance_rate": ("2.80", "0.40"),
                        "time_rate": ("0.65", "0.15"), "minimum_fare": ("9.50", "1.50")}),
    (5, 8, "URBAN", {"base_fare": ("5.50", "1.50"), "distance_rate": ("2.20", "0.30"),
                     "time_rate": ("0.45", "0.15"), "minimum_fare": ("6.00", "1.00")}),
    (9, 12, "SUBURBAN", {"base_fare": ("4.00", "1.00"), "distance_rate": ("1.80", "0.20"),
                         "time_rate": ("0.30", "0.10"), "minimum_fare": ("4.50", "0.50")}),
    (13, 16, "AIRPORT", {"base_fare": ("12.00", "3.00"), "distance_rate": ("3.50", "0.50"),
                         "time_rate": ("0.80", "0.20"), "minimum_fare": ("15.00", "2.00")}),
)
RATE_TYPES = {
    "base_fare": "decimal(8,2)",
    "distance_rate": "decimal(6,2)",
    "time_rate": "decimal(6,2)",
    "minimum_fare": "decimal(8,2)",
}


def band_zones(spark: SparkSession) -> DataFrame:
    """All zones that belong to a band."""
    return spark.range(BANDS[0][0], BANDS[-1][1] + 1).select(F.col("id").cast("int").alias("zone_id"))


def draw(zone_id: Column, rate: str, seed: int) -> Column:
    """A value in [0, 1) that depends on zone, rate and seed only.

    Unlike ``rand`` it does not change with the partitioning or when a lost task runs again.
    """
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(rate), zone_id.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(2**32)


def build_fare_table(zones: DataFrame, seed: int = 0, created_ms: int | None = None) -> DataFrame:
    """A fare row for each zone of ``zones`` that lies in a band; rates drawn within the band."""
    zone = F.col("zone_id")

    def by_band(pick) -> Column:
        first, last, *_ = BANDS[0]
        value = F.when(zone.between(first, last), pick(BANDS[0]))
        for band in BANDS[1:]:
            value = value.when(zone.between(band[0], band[1]), pick(band))
        return value

    def rate(name: str) -> Column:
        def drawn(band) -> Column:
            low, width = band[3][name]
            extra = F.round((draw(zone, name, seed) * F.lit(float(width))).cast("decimal(20,10)"), 2)
            return (F.lit(low).cast("decimal(8,2)") + extra).cast(RATE_TYPES[name])

        return by_band(drawn).alias(name)

    return (
        zones.filter(zone.between(BANDS[0][0], BANDS[-1][1]))
        .select("zone_id")
        .distinct()
        .select(
            "zone_id",
            *[rate(name) for name in RATE_TYPES],
            by_band(lambda band: F.lit(band[2])).alias("zone_type"),
            F.lit(True).alias("active"),
            instant(created_ms).alias("created_at"),
            instant(created_ms).alias("updated_at"),
        )
    )
