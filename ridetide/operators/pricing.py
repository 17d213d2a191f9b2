"""Current prices and quotes: requests joined with at most one row per zone on each side.

The request side is never shuffled: both lookup sides are bounded by the zone range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridetide.functions.fare import FARE_TYPE, quoted_fare, with_reference_fare
from ridetide.functions.instants import RATIO_TYPE, SURGE_TYPE, from_millis, instant, to_millis
from ridetide.operators.asof import as_of
from ridetide.operators.lookup import zone_row
from ridetide.operators.validate import guard_zones, valid_quotes
from ridetide.params import QUOTE_ZONES, READ_ZONES

RESPONSE_COLUMNS = (
    "zone_id",
    "surge_multiplier",
    "quoted_fare",
    "updated_at",
    "demand",
    "supply",
    "ratio",
)


def _with_lookups(
    requests: DataFrame, snapshot: DataFrame, fares: DataFrame, zones: tuple[int, int]
) -> DataFrame:
    """Left joins on ``zone_id``: a miss leaves the ``snap`` or ``fare`` struct null."""
    fare_order = F.struct("updated_at", "base_fare", "distance_rate", "time_rate", "minimum_fare")
    return requests.join(
        zone_row(snapshot, zones, F.struct("updated_at", "window_start"), "snap", "zone_id"), "zone_id", "left"
    ).join(zone_row(fares, zones, fare_order, "fare", "zone_id"), "zone_id", "left")


def _snapshot_or_default() -> dict:
    surge, ratio = F.lit("1").cast(SURGE_TYPE), F.lit("0").cast(RATIO_TYPE)
    none = F.lit(0).cast("bigint")
    return {
        "surge_multiplier": F.coalesce(F.col("snap.surge_multiplier"), surge),
        "demand": F.coalesce(F.col("snap.demand"), none),
        "supply": F.coalesce(F.col("snap.supply"), none),
        "ratio": F.coalesce(F.col("snap.ratio"), ratio),
    }


def zone_prices(
    requests: DataFrame,
    snapshot: DataFrame,
    fares: DataFrame,
    as_of_ms: int | None = None,
    zones: tuple[int, int] = READ_ZONES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Current price of each requested zone, for the default trip.

    A zone without a snapshot has no fare (null), unlike a quote.
    """
    accepted, _ = guard_zones(requests, zones)
    unknown = F.lit(None).cast("double")
    fare = quoted_fare(F.col("reference_fare"), F.col("snap.surge_multiplier"))
    return (
        with_reference_fare(_with_lookups(accepted, snapshot, fares, zones), unknown, unknown)
        .withColumns(
            {
                **_snapshot_or_default(),
                "quoted_fare": F.when(F.col("snap").isNotNull(), fare).cast(FARE_TYPE),
                "updated_at": F.coalesce(F.col("snap.updated_at"), instant(as_of_ms)),
            }
        )
        .select(*carry, *RESPONSE_COLUMNS)
    )


def quotes(
    requests: DataFrame,
    snapshot: DataFrame,
    fares: DataFrame,
    as_of_ms: int | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Quote of each valid request. The destination does not enter the fare.

    A zone without a snapshot is quoted at surge 1; a zone without a fare row at its fallback.
    Works on a streaming request frame too (stream-static joins).
    """
    requested = valid_quotes(requests).withColumn("zone_id", F.col("origin_zone_id"))
    return answered(_with_lookups(requested, snapshot, fares, QUOTE_ZONES), instant(as_of_ms), carry)


def answered(requested: DataFrame, updated_at: Column, carry: tuple[str, ...]) -> DataFrame:
    """Valid requests with their ``snap`` and ``fare`` rows, or nulls -> quotes."""
    surge = F.coalesce(F.col("snap.surge_multiplier"), F.lit("1").cast(SURGE_TYPE))
    fare = quoted_fare(F.col("reference_fare"), surge)
    fared = with_reference_fare(requested, F.col("estimated_distance_km"), F.col("estimated_duration_min"))
    priced = {**_snapshot_or_default(), "quoted_fare": fare, "updated_at": updated_at}
    return fared.withColumns(priced).select(*carry, *RESPONSE_COLUMNS)


PRICE_FIELDS = ("surge_multiplier", "demand", "supply", "ratio")
FARE_FIELDS = ("base_fare", "distance_rate", "time_rate", "minimum_fare", "zone_type")

# A minute: twelve windows of the default length.
CELL_MS = 60_000


def quotes_as_of(
    requests: DataFrame, history: DataFrame, fares: DataFrame, cell_ms: int = CELL_MS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Quote of each valid request at its own time ``ts``: by the window that was the newest computed
    and the fare row that was the newest stored at that moment.

    ``history`` has a row per zone and window, known from ``ts_compute`` on; ``fares`` a row per zone and
    change, known from ``updated_at`` on. Where nothing was known yet, the defaults of ``quotes`` hold.
    """
    requested = valid_quotes(requests).withColumn("zone_id", F.col("origin_zone_id"))
    facts = {
        "snap": (history, to_millis(F.col("ts_compute")), PRICE_FIELDS),
        "fare": (fares, to_millis(F.col("updated_at")), FARE_FIELDS),
    }
    return answered(as_of(requested, "zone_id", "ts", facts, cell_ms), from_millis(F.col("ts")), carry)
