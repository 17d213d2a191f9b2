"""The given tables read as ride requests, heartbeats, quote requests and subscriptions.

Every mapping is a rule over all rows of its table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridetide import schemas
from ridetide.functions.instants import instant, to_millis
from ridetide.operators.normalize import AVAILABLE, HEARTBEAT, RIDE
from ridetide.sources.fares import band_zones, build_fare_table

# The events span 30 days, so windows of six hours.
WINDOW_MS = 21_600_000
ZONES = 16
REQUEST_ZONES = 64

# "Now" of all registered queries: 2024-02-01T00:00:00Z.
AS_OF_MS = 1_706_745_600_000
# Range of the range queries: 2024-01-10T00:00:00Z .. 2024-01-20T00:00:00Z.
FROM_MS, TO_MS = 1_704_844_800_000, 1_705_708_800_000
DAY_MS = 86_400_000

# Zone of the single-zone queries, and riders that each ride stands for in a crowded window.
HISTORY_ZONE = 3
CROWD = 1_500_007

RIDE_TYPES = ("purchase", "click")
AVAILABLE_TYPES = ("view", "signup")

FARE_COLUMNS = ("zone_id", "base_fare", "distance_rate", "time_rate", "minimum_fare", "zone_type", "active")

# Fixed sample values of the fare table. Zone 4 has no row; zone 17 has no band and is inactive.
SAMPLE_FARES = (
    (1, "8.00", "2.80", "0.65", "9.50", "DOWNTOWN", True),
    (2, "8.50", "2.90", "0.69", "9.90", "DOWNTOWN", True),
    (3, "9.00", "3.00", "0.73", "10.30", "DOWNTOWN", True),
    (5, "5.50", "2.20", "0.45", "6.00", "URBAN", True),
    (6, "5.90", "2.28", "0.49", "6.25", "URBAN", True),
    (7, "6.30", "2.36", "0.53", "6.50", "URBAN", True),
    (8, "6.70", "2.44", "0.57", "6.75", "URBAN", True),
    (9, "4.00", "1.80", "0.30", "4.50", "SUBURBAN", True),
    (10, "4.25", "1.85", "0.33", "4.62", "SUBURBAN", True),
    (11, "4.50", "1.90", "0.36", "4.75", "SUBURBAN", True),
    (12, "4.75", "1.95", "0.39", "4.87", "SUBURBAN", True),
    (13, "12.00", "3.50", "0.80", "15.00", "AIRPORT", True),
    (14, "12.75", "3.63", "0.85", "15.50", "AIRPORT", True),
    (15, "13.50", "3.75", "0.90", "16.00", "AIRPORT", True),
    (16, "14.25", "3.88", "0.95", "16.50", "AIRPORT", True),
    (17, "5.00", "2.00", "0.50", "6.00", "STANDARD", False),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream. The braces make the path a pattern, for a file or a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}.parquet}}")


def _is_ride() -> Column:
    return F.col("event_type").isin(*RIDE_TYPES)


def _is_heartbeat() -> Column:
    return F.col("event_type").isNull() | ~_is_ride()


def _heartbeat_status() -> Column:
    return F.when(F.col("event_type").isin(*AVAILABLE_TYPES), F.lit(AVAILABLE)).otherwise(F.lit("BUSY"))


def _zone() -> Column:
    return (F.col("user_id") % ZONES + 1).cast("int")


def _event_ms() -> Column:
    return to_millis(F.col("ts").cast("timestamp"))


def _event_columns() -> list[Column]:
    kind = F.when(_is_ride(), F.lit(RIDE)).otherwise(F.lit(HEARTBEAT))
    return [
        kind.alias("kind"),
        _zone().alias("zone_id"),
        _event_ms().alias("ts_event"),
        F.when(_is_heartbeat(), _heartbeat_status()).alias("status"),
    ]


def events_of(table_rows: DataFrame) -> DataFrame:
    """Rows of the events table as normalised events."""
    return table_rows.select(*_event_columns())


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(table(spark, sf_dir, "events"))


def events_between(spark: SparkSession, sf_dir: str, from_ms: int, to_ms: int) -> DataFrame:
    """Events of windows that lie fully inside the range; the bounds reach the scan."""
    time = F.col("ts")
    rows = table(spark, sf_dir, "events")
    low, high = (instant(ms).cast(rows.schema["ts"].dataType) for ms in (from_ms, to_ms))
    return events_of(rows.filter((time >= low) & (time < high)))


# Instants at which the snapshot over the seed rows is asked for: a quarter of an hour, doubled again and again.
INSTANTS = 13
INSTANT_MS = 900_000

# The sequence queries read the events in slices of four days, one per micro-batch.
SLICE_MS = 4 * DAY_MS
FIRST_MS = 1_704_067_200_000
SLICES = 10


# The live queries read requests and updates in slices of a week.
LIVE_SLICE_MS = 7 * DAY_MS
LIVE_SLICES = 5


def slice_of(ms: Column, late: Column) -> Column:
    """The slice of a moment, or the next one where ``late``."""
    due = F.floor((ms - F.lit(FIRST_MS)) / F.lit(LIVE_SLICE_MS)) + F.when(late, 1).otherwise(0)
    return F.greatest(F.lit(0), F.least(due, F.lit(LIVE_SLICES - 1))).cast("int").alias("slice")


def sliced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paced quote requests by the slice they arrive in: every eleventh one slice late."""
    rows = paced_requests(spark, sf_dir)
    return rows.select("*", slice_of(F.col("ts"), F.col("request_id") % 11 == 0))


def sliced_updates(updates: DataFrame) -> DataFrame:
    """Price updates by the slice they arrive in: some windows one slice late."""
    late = (F.floor(F.col("window_start") / WINDOW_MS) + F.col("zone_id")) % 7 == 0
    return updates.select("*", slice_of(F.col("ts_compute"), late))


# Slices of the seeded snapshot: up to a quarter of an hour, then four times as long each.
SEED_SLICES = 7


def seed_slice(ms: Column) -> Column:
    ends = [FIRST_MS + INSTANT_MS * 4**k for k in range(SEED_SLICES - 1)]
    return sum([(ms > F.lit(end)).cast("int") for end in ends], F.lit(0)).alias("slice")


def sliced_events(spark: SparkSession, sf_dir: str, rides_lag: int) -> DataFrame:
    """Normalised events with the ``slice`` they arrive in: that of their time, some one or three slices
    late, and rides ``rides_lag`` slices later."""
    rows = table(spark, sf_dir, "events")
    event = F.col("event_id")
    late = F.when(event % 13 == 0, 3).when(event % 11 == 0, 1).otherwise(0)
    lag = F.when(_is_ride(), F.lit(rides_lag)).otherwise(0)
    due = F.floor((_event_ms() - F.lit(FIRST_MS)) / F.lit(SLICE_MS)) + late + lag
    return rows.select(F.least(due, F.lit(SLICES - 1)).cast("int").alias("slice"), *_event_columns())


def event_streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rides, heartbeats) as two streams of normalised events."""
    rides = table_stream(spark, sf_dir, "events").filter(_is_ride())
    heartbeats = table_stream(spark, sf_dir, "events").filter(_is_heartbeat())
    return events_of(rides), events_of(heartbeats)


def _ride_fields() -> dict[str, Column]:
    event = F.col("event_id")
    payment = F.when(event % 3 == 0, "CARD").when(event % 3 == 1, "PIX").otherwise("CASH")
    return {
        "event_id": _uuid(event),
        "rider_id": _uuid(F.col("user_id")),
        "zone_id": _zone(),
        "est_distance_km": F.col("value"),
        "est_duration_min": F.col("value") / 2,
        "payment_type": payment,
        "ts_event": _event_ms(),
    }


def _heartbeat_fields() -> dict[str, Column]:
    return {
        "driver_id": _uuid(F.col("user_id")),
        "zone_id": _zone(),
        "status": _heartbeat_status(),
        "ts_event": _event_ms(),
    }


def _uuid(number: Column) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(number.cast("string"), 12, "0"))


def _as_struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[column.alias(name) for name, column in fields.items()])


def payloads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rides, heartbeats) as (event_id, value) with JSON payloads."""
    rows = table(spark, sf_dir, "events")
    rides = rows.filter(_is_ride()).select("event_id", F.to_json(_as_struct(_ride_fields())).alias("value"))
    beats = rows.filter(_is_heartbeat()).select("event_id", F.to_json(_as_struct(_heartbeat_fields())).alias("value"))
    return rides, beats


def damaged_payloads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Payloads in all conditions, by ``event_id % 7``: 0 whole, 1 cut off, 2 in an array,
    3 without zone, 4 with an unreadable zone, 5 with a quoted fractional zone, 6 without time. Of the whole
    ones a third has a zone of 20 and a third one of 40 digits, whose low 32 bits are the zone.
    """
    case = F.col("event_id") % 7

    def built(fields: dict[str, Column]) -> Column:
        # A null field is left out of the text.
        zone = fields["zone_id"]
        time = F.when(case != 6, fields["ts_event"])
        plain = F.to_json(_as_struct({**fields, "zone_id": F.when(case != 3, zone), "ts_event": time}))
        text = F.when(case == 4, "x").otherwise(F.concat(F.lit(" "), zone.cast("string"), F.lit(".9 ")))
        quoted = F.to_json(_as_struct({**fields, "zone_id": text}))
        of_three = F.col("event_id") % 21
        # Both are multiples of 2**32, and end in two zeros: the zone takes their place.
        head = F.when(of_three == 7, str(2**32 * 25 * 10**8)[:-2]).when(of_three == 14, str(10**39)[:-2])
        long = F.concat(F.lit('"zone_id":'), head, F.lpad(zone.cast("string"), 2, "0"))
        return (
            F.when(head.isNotNull(), F.replace(plain, F.concat(F.lit('"zone_id":'), zone.cast("string")), long))
            .when(case.isin(4, 5), quoted)
            .when(case == 1, F.rtrim(plain, F.lit("}")))
            .when(case == 2, F.concat(F.lit("["), plain, F.lit("]")))
            .otherwise(plain)
        )

    rows = table(spark, sf_dir, "events")
    rides = rows.filter(_is_ride()).select("event_id", built(_ride_fields()).alias("value"))
    beats = rows.filter(_is_heartbeat()).select("event_id", built(_heartbeat_fields()).alias("value"))
    return rides, beats


def contract_payloads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Payloads that break contracts, by ``event_id % 6``: 1 zone too large, 2 negative time,
    3 unknown payment or status, 4 quoted zone and plain id, 5 extra field and a missing one.
    """
    case = F.col("event_id") % 6

    def built(fields: dict[str, Column], id_field: str, enum_field: str) -> Column:
        # A null field is left out of the text.
        zone, time, name = fields["zone_id"], fields["ts_event"], fields[enum_field]
        changed = {
            **fields,
            id_field: F.when(case == 4, "plain").otherwise(fields[id_field]),
            "zone_id": F.when(case == 1, zone + 64).otherwise(zone),
            "ts_event": F.when(case == 2, -time).otherwise(time),
            enum_field: F.when(case == 3, "OTHER").when(case != 5, name),
            "extra": F.when(case == 5, 1),
        }
        quoted = {**changed, "zone_id": zone.cast("string")}
        return F.when(case == 4, F.to_json(_as_struct(quoted))).otherwise(F.to_json(_as_struct(changed)))

    rows = table(spark, sf_dir, "events")
    rides = rows.filter(_is_ride()).select(
        "event_id", built(_ride_fields(), "event_id", "payment_type").alias("value")
    )
    beats = rows.filter(_is_heartbeat()).select(
        "event_id", built(_heartbeat_fields(), "driver_id", "status").alias("value")
    )
    return rides, beats


def broken_updates(updates: DataFrame) -> DataFrame:
    """Price updates as (zone_id, window_start, value), a tenth of them whole; each other tenth breaks
    another field, by window and zone: 1 zone too large, 2 negative start, 3 quoted end, 4 no demand,
    5 fractional supply, 6 negative ratio, 7 no compute time, 8 negative fare, 9 an unknown field.
    """
    case = (F.floor(F.col("window_start") / WINDOW_MS) + F.col("zone_id")) % 10
    names = schemas.PRICE_UPDATE_FIELDS
    changed = {
        **{name: F.col(name) for name in names},
        "zone_id": F.when(case == 1, F.col("zone_id") + 64).otherwise(F.col("zone_id")),
        "window_start": F.when(case == 2, -F.col("window_start")).otherwise(F.col("window_start")),
        "demand": F.when(case != 4, F.col("demand")),
        "ratio": F.when(case == 6, F.lit(-1.0)).otherwise(F.col("ratio")),
        "ts_compute": F.when(case != 7, F.col("ts_compute")),
        "reference_fare": F.when(case == 8, F.lit(-1.0)),
        "extra": F.when(case == 9, 1),
    }
    quoted = {**changed, "window_end": F.col("window_end").cast("string")}
    fractional = {**changed, "supply": F.col("supply") + F.lit(0.5)}
    # A null field is left out of the text.
    value = (
        F.when(case == 3, F.to_json(_as_struct(quoted)))
        .when(case == 5, F.to_json(_as_struct(fractional)))
        .otherwise(F.to_json(_as_struct(changed)))
    )
    return updates.select("zone_id", "window_start", value.alias("value"))


def sample_fares(spark: SparkSession) -> DataFrame:
    rows = ", ".join(
        f"({zone}, {', '.join(rates)}, '{kind}', {active})" for zone, *rates, kind, active in SAMPLE_FARES
    )
    fares = spark.sql(f"SELECT * FROM VALUES {rows} AS f({', '.join(FARE_COLUMNS)})")
    typed = schemas.FARE_CONFIG.split(", ")[: len(FARE_COLUMNS)]
    return fares.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in typed]).withColumns(
        {"created_at": instant(AS_OF_MS), "updated_at": instant(AS_OF_MS)}
    )


def quote_requests_of(orders: DataFrame) -> DataFrame:
    """Orders as quote requests; some without estimates, some invalid, some of enormous size."""
    order, price = F.col("o_orderkey"), F.col("o_totalprice")
    return orders.select(
        order.alias("request_id"),
        F.when(order % 97 == 0, F.lit(0))
        .otherwise((F.col("o_custkey") % REQUEST_ZONES + 1).cast("int"))
        .alias("origin_zone_id"),
        (order % REQUEST_ZONES + 1).cast("int").alias("destination_zone_id"),
        F.when(order % 101 == 0, F.lit(-1.0))
        .when(order % 103 == 0, price * F.lit(1e4))
        .when(order % 107 == 0, price * F.lit(1e10))
        .when(order % 109 == 0, price * F.lit(1e20))
        .when(order % 5 != 0, price / F.lit(20000.0))
        .alias("estimated_distance_km"),
        F.when(order % 113 == 0, price * F.lit(1e5))
        .when(order % 7 != 0, price / F.lit(9000.0))
        .alias("estimated_duration_min"),
        to_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"),
    )


# The orders' first day, 1992-01-01, falls on the events' first, and their time goes eighty times faster.
ORDERS_MS, PACE = 694_224_000_000, 80


def paced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote requests over the days of the events, with the moment of each."""
    rows = quote_requests(spark, sf_dir)
    after = F.expr(f"(ts - {ORDERS_MS}) div {PACE}")
    # Orders have dates only: the request id spreads them over their quarter of an hour.
    return rows.withColumn("ts", F.lit(FIRST_MS) + after + F.col("request_id") % 900_000)


# When fares were set anew, with a draw of its own each time.
FARE_CHANGES = (FIRST_MS, FROM_MS + 1, TO_MS)


def fare_versions(spark: SparkSession) -> DataFrame:
    """A fare row for every zone of a band and change."""
    zones = band_zones(spark)
    tables = [build_fare_table(zones, seed=n, created_ms=at) for n, at in enumerate(FARE_CHANGES, start=1)]
    return reduce(DataFrame.unionByName, tables)


def quote_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_requests_of(table(spark, sf_dir, "orders"))


def price_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price request per order, for zones 1..64."""
    zone = (F.col("o_custkey") % REQUEST_ZONES + 1).cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), zone.alias("zone_id"))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subscription per supplier, to a zone by its nation: 1..25, not all of them accepted."""
    zone = (F.col("s_nationkey") + 1).cast("int")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subscriber_id"), zone.alias("zone_id"))
