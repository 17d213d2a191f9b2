"""Raw JSON payloads -> normalised events; refused payloads with their reason; decoded updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridetide.functions import payload
from ridetide.functions.contracts import Contract, contract_violations, field_readings, parse_document
from ridetide.functions.instants import RATIO_TYPE, SURGE_TYPE, from_millis, table_decimal
from ridetide.schemas import PRICE_UPDATE_FIELDS

RIDE = "RIDE"
HEARTBEAT = "HEARTBEAT"
AVAILABLE = "AVAILABLE"

REQUIRED_FIELDS = {
    RIDE: ("zone_id", "ts_event"),
    HEARTBEAT: ("zone_id", "ts_event", "status"),
}

_FIELDS = "__fields"
_USABLE = "__usable"


def _in_range(ts_event: Column) -> Column:
    """An event time that a TIMESTAMP can hold; beyond it no window can be formed."""
    return ts_event.between(-payload.TIMESTAMP_MAX_MS, payload.TIMESTAMP_MAX_MS)


def _parsed(raw: DataFrame, names: tuple[str, ...], value: str) -> DataFrame:
    return raw.withColumn(_FIELDS, payload.parse_object(F.col(value), names))


def normalize(
    raw: DataFrame, kind: str, value: str = "value", carry: tuple[str, ...] = (), counted: str | None = None
) -> DataFrame:
    """Keep usable payloads as (kind, zone_id, ts_event, status) plus the ``carry`` columns.

    Zero or one row per payload, by a generator: a filter would be pushed below the parsing
    projection and parse every payload twice. ``counted`` names an observed metric of the running
    query with the payloads received and refused.
    """
    fields, raw_value, names = F.col(_FIELDS), F.col(value), REQUIRED_FIELDS[kind]
    status = payload.as_text(fields, "status") if kind == HEARTBEAT else F.lit(None).cast("string")
    read = _parsed(raw, names, value).select(
        *carry,
        F.lit(kind).alias("kind"),
        payload.as_int(fields, "zone_id", raw_value).alias("zone_id"),
        payload.as_long(fields, "ts_event", raw_value).alias("ts_event"),
        status.alias("status"),
        payload.is_usable(fields, raw_value, names).alias(_USABLE),
    )
    usable = F.col(_USABLE) & _in_range(F.col("ts_event"))
    if counted:
        read = read.observe(counted, F.count(F.lit(1)).alias("received"), F.count_if(~usable).alias("refused"))
    event = F.array(F.struct("kind", "zone_id", "ts_event", "status"))
    kept = F.when(usable, event)
    return read.select(*carry, F.inline(kept))


def _reason(kind: str, raw_value: Column) -> Column:
    """Why a payload is refused; null if it is usable."""
    fields, names = F.col(_FIELDS), REQUIRED_FIELDS[kind]
    reason = F.when(~payload.is_object(fields, raw_value), F.lit("unparsable"))
    for name in names:
        reason = reason.when(~payload.has_field(fields, raw_value, name), F.lit(f"missing {name}"))
    ts_event = payload.as_long(fields, "ts_event", raw_value)
    return reason.when(~_in_range(ts_event), F.lit("ts_event out of range"))


def quarantine(raw: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """The payloads that ``normalize`` leaves out, with all their columns and a reason."""
    reason = _reason(kind, F.col(value))
    judged = _parsed(raw, REQUIRED_FIELDS[kind], value).select(*raw.columns, reason.alias("reason"))
    refused = F.when(F.col("reason").isNotNull(), F.array(F.struct("reason")))
    return judged.select(*raw.columns, F.inline(refused))


# Outcomes of a payload, and what ``judge`` gives for one.
EVENT, REFUSED = "event", "refused"
JUDGED = "zone_id INT, ts_event BIGINT, status STRING, value STRING, reason STRING, kind STRING, outcome STRING"


def judge(raw: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """Every payload, parsed once: as an event, or with its text and the reason why it is none."""
    fields, raw_value = F.col(_FIELDS), F.col(value)
    status = payload.as_text(fields, "status") if kind == HEARTBEAT else F.lit(None).cast("string")
    read = _parsed(raw, REQUIRED_FIELDS[kind], value).select(
        raw_value.alias("text"),
        payload.as_int(fields, "zone_id", raw_value).alias("zone_id"),
        payload.as_long(fields, "ts_event", raw_value).alias("ts_event"),
        status.alias("status"),
        _reason(kind, raw_value).alias("reason"),
    )
    usable = F.col("reason").isNull()
    row = F.struct(
        *[F.when(usable, F.col(name)).alias(name) for name in ("zone_id", "ts_event", "status")],
        F.when(~usable, F.col("text")).alias("value"),
        "reason",
        F.lit(kind).alias("kind"),
        F.when(usable, EVENT).otherwise(REFUSED).alias("outcome"),
    )
    # By a generator: what reads a column of the result must not pull the parsing apart.
    return read.select(F.inline(F.array(row)))


def check_contract(
    raw: DataFrame, contract: Contract, value: str = "value", check_format: bool = True
) -> DataFrame:
    """Add ``violations ARRAY<STRING>``; opt-in, drops nothing."""
    document = F.col("__document")
    parts = {name: field_readings(document, name, rule) for name, rule in contract.fields.items()}
    read = raw.withColumn("__document", parse_document(F.col(value))).withColumns(
        {f"__{name}_{part}": column for name, columns in parts.items() for part, column in columns.items()}
    )
    readings = {name: {part: F.col(f"__{name}_{part}") for part in columns} for name, columns in parts.items()}
    found = contract_violations(document, readings, contract, check_format)
    return read.select(*raw.columns, found.alias("violations"))


def with_event_time(events: DataFrame) -> DataFrame:
    """Event time from the payload, never from the transport."""
    return events.withColumn("event_time", from_millis(F.col("ts_event")))


def union_events(rides: DataFrame, heartbeats: DataFrame) -> DataFrame:
    return rides.unionByName(heartbeats)


def decode_price_updates(raw: DataFrame, value: str = "value", carry: tuple[str, ...] = ()) -> DataFrame:
    """Price-update payloads -> wire columns. Fails on the first unusable payload."""
    fields, raw_value = F.col(_FIELDS), F.col(value)
    problem = F.concat(F.lit("unusable price update: "), F.coalesce(raw_value, F.lit("null")))
    checked = F.when(payload.is_usable(fields, raw_value, PRICE_UPDATE_FIELDS), F.lit(True)).otherwise(
        F.raise_error(problem).cast("boolean")
    )
    update = F.array(
        F.struct(
            *[
                _WIRE_READERS.get(name, payload.as_long)(fields, name, raw_value).alias(name)
                for name in PRICE_UPDATE_FIELDS
            ]
        )
    )
    return _parsed(raw, PRICE_UPDATE_FIELDS, value).select(*carry, F.inline(F.when(checked, update)))


_WIRE_READERS = {
    "zone_id": payload.as_int,
    "ratio": payload.as_double,
    "surge_multiplier": payload.as_double,
}


def to_table_types(updates: DataFrame) -> DataFrame:
    """Wire columns -> history columns: UTC instants, decimals rounded half-up."""
    return updates.withColumns(
        {
            "window_start": from_millis(F.col("window_start")),
            "window_end": from_millis(F.col("window_end")),
            "ratio": table_decimal(F.col("ratio"), RATIO_TYPE),
            "surge_multiplier": table_decimal(F.col("surge_multiplier"), SURGE_TYPE),
            "ts_compute": from_millis(F.col("ts_compute")),
        }
    )
