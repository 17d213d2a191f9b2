"""Case-insensitive names with an error for unknown ones.

Only for callers that ask for it: normalisation and counting compare case-sensitively.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EVENT_KINDS = ("RIDE", "HEARTBEAT")
HEARTBEAT_STATUSES = ("AVAILABLE", "BUSY")


def _parse(text: Column, names: tuple[str, ...], what: str) -> Column:
    name = F.upper(text)
    problem = F.concat(F.lit(f"unknown {what}: "), F.coalesce(text, F.lit("null")))
    return F.when(name.isin(*names), name).otherwise(F.raise_error(problem).cast("string"))


def parse_event_kind(text: Column) -> Column:
    return _parse(text, EVENT_KINDS, "event kind")


def parse_heartbeat_status(text: Column) -> Column:
    return _parse(text, HEARTBEAT_STATUSES, "heartbeat status")
