"""Epoch milliseconds, table decimals and ISO texts. Times are UTC."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIO_TYPE = "decimal(24,4)"
SURGE_TYPE = "decimal(4,2)"


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def to_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def window_start_ms(ms: Column, size_ms: int) -> Column:
    """Start of the epoch-aligned tumbling window, also right before 1970."""
    return ms - F.pmod(ms, F.lit(size_ms).cast("bigint"))


def table_decimal(number: Column, sql_type: str) -> Column:
    """Shortest decimal text of the double, rounded half-up; fails when the type cannot hold it,
    whatever the ANSI setting of the session."""
    problem = F.concat(F.lit(f"out of range for {sql_type}: "), number.cast("string"))
    overflow = F.when(number.isNotNull(), F.raise_error(problem).cast(sql_type))
    return F.coalesce(number.try_cast(sql_type), overflow)


def instant(ms: int | None) -> Column:
    """Literal instant; the current one when ``ms`` is None."""
    return F.current_timestamp() if ms is None else F.timestamp_millis(F.lit(ms).cast("bigint"))


def now_ms() -> int:
    return int(datetime.now(timezone.utc).timestamp() * 1000)


def iso_text(ts: Column, always_seconds: bool = True) -> Column:
    """ISO-8601 UTC text with as many fraction digits (0, 3 or 6) as the value needs.

    With ``always_seconds=False`` whole minutes are written without ``:00``.
    """
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))
    micros = F.unix_micros(ts)
    fraction = (
        F.when(F.pmod(micros, F.lit(1_000_000)) == 0, F.date_format(utc, ":ss"))
        .when(F.pmod(micros, F.lit(1_000)) == 0, F.date_format(utc, ":ss.SSS"))
        .otherwise(F.date_format(utc, ":ss.SSSSSS"))
    )
    if not always_seconds:
        fraction = F.when(F.pmod(micros, F.lit(60_000_000)) == 0, F.lit("")).otherwise(fraction)
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm"), fraction, F.lit("Z"))
