"""Reference and quoted fares in exact decimal arithmetic."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wide enough for the largest estimates; times a surge it still fits 38 digits.
FARE_TYPE = "decimal(33,2)"

# Distances and minutes keep 16 decimals, so that every double from 1 up is exact, and 22 whole
# digits. Only what exceeds these 38 digits is refused as a request.
ESTIMATE_TYPE = "decimal(38,16)"
ESTIMATE_LIMIT = 1e22

# Trip assumed when a request gives none (kilometres, minutes), by zone type.
DEFAULT_TRIPS = {
    "DOWNTOWN": (4.2, 12.0),
    "URBAN": (6.8, 15.0),
    "SUBURBAN": (8.5, 18.0),
    "AIRPORT": (12.0, 25.0),
}
DEFAULT_TRIP_OTHER = (6.0, 15.0)

# Fare of a zone without a fare row, (highest zone, fare) and the rest.
FALLBACK_FARES = ((16, "22.50"), (32, "16.80"), (48, "12.30"))
FALLBACK_FARE_OTHER = "35.00"


def _default_trip(zone_type: Column, part: int) -> Column:
    known = iter(DEFAULT_TRIPS.items())
    name, trip = next(known)
    value = F.when(zone_type == name, F.lit(trip[part]))
    for name, trip in known:
        value = value.when(zone_type == name, F.lit(trip[part]))
    return value.otherwise(F.lit(DEFAULT_TRIP_OTHER[part]))


def effective_km(km: Column, zone_type: Column) -> Column:
    return F.coalesce(km, _default_trip(zone_type, 0))


def effective_minutes(minutes: Column, zone_type: Column) -> Column:
    return F.coalesce(minutes, _default_trip(zone_type, 1))


def fallback_fare(zone_id: Column) -> Column:
    def money(text: str) -> Column:
        return F.lit(text).cast(FARE_TYPE)

    (first_zone, first_fare), *bands = FALLBACK_FARES
    fare = F.when(zone_id <= first_zone, money(first_fare))
    for last_zone, amount in bands:
        fare = fare.when(zone_id <= last_zone, money(amount))
    return fare.otherwise(money(FALLBACK_FARE_OTHER))


# Below this fare a sum of doubles is off by less than a ten-thousandth of a cent.
CLEAR_CENTS = 1e9
CLEAR_OF_HALF = 1e-4


def with_reference_fare(rows: DataFrame, km: Column, minutes: Column, fare_row: str = "fare") -> DataFrame:
    """Add ``reference_fare``, the fare before surge. ``fare_row`` names a struct column, null when the zone
    ``zone_id`` has no fare.

    A sum of doubles decides the cent wherever it is clear of half a cent by more than its error can be; only
    the other fares are added up exactly. The trip is a step of its own: within one expression it would stand
    eight times, too much code for the compiler of the JVM.
    """

    def rate(name: str) -> Column:
        return F.col(f"{fare_row}.{name}")

    zone_type = rate("zone_type")
    trip = {"__km": effective_km(km, zone_type), "__minutes": effective_minutes(minutes, zone_type)}
    km, minutes = F.col("__km"), F.col("__minutes")
    by_km, by_minute = rate("distance_rate"), rate("time_rate")
    cents = F.lit(100.0) * (
        rate("base_fare").cast("double") + by_km.cast("double") * km + by_minute.cast("double") * minutes
    )
    cents_off = F.col("__cents") - F.floor("__cents") - F.lit(0.5)
    is_clear = (F.col("__cents") < F.lit(CLEAR_CENTS)) & (F.abs(cents_off) > F.lit(CLEAR_OF_HALF))
    nearest = F.floor(F.col("__cents") + F.lit(0.5)).cast("decimal(18,0)") * F.lit(Decimal("0.01"))
    fare = F.when(is_clear, nearest.cast(FARE_TYPE)).otherwise(_exact_fare(rate, km, minutes))
    floored = F.greatest(fare, rate("minimum_fare").cast(FARE_TYPE))
    reference = F.when(F.col(fare_row).isNull(), fallback_fare(F.col("zone_id"))).otherwise(floored)
    added = rows.withColumns(trip).withColumn("__cents", cents).withColumn("reference_fare", reference)
    return added.drop("__km", "__minutes", "__cents")


def _exact_fare(rate: Callable[[str], Column], km: Column, minutes: Column) -> Column:
    """In decimals that keep every digit. A lambda, so that this rare and large piece of code is not compiled
    into the loop over the rows, which the compiler of the JVM would then leave alone."""
    trip = F.array(F.struct(km.cast(ESTIMATE_TYPE).alias("km"), minutes.cast(ESTIMATE_TYPE).alias("minutes")))

    def fare(trip: Column) -> Column:
        km_whole, km_part = _split(trip["km"])
        minutes_whole, minutes_part = _split(trip["minutes"])
        # Whole units give whole cents, so only the parts below one unit take part in the rounding.
        whole = rate("base_fare") + rate("distance_rate") * km_whole + rate("time_rate") * minutes_whole
        parts = rate("distance_rate") * km_part + rate("time_rate") * minutes_part
        return (whole + F.round(parts, 2)).cast(FARE_TYPE)

    return F.get(F.transform(trip, fare), F.lit(0))


def _split(exact: Column) -> tuple[Column, Column]:
    """An estimate as its whole units and the exact rest: the two together keep every digit."""
    whole = F.floor(exact).cast("decimal(22,0)")
    return whole, (exact - whole).cast("decimal(17,16)")


def quoted_fare(reference: Column, surge: Column) -> Column:
    """Second rounding: the reference fare is already rounded to cents."""
    return F.round(reference * surge, 2).cast(FARE_TYPE)
