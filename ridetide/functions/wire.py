"""Wire form of a price update: key bytes and JSON value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridetide.schemas import PRICE_UPDATE_FIELDS


def zone_key(zone_id: Column) -> Column:
    """Zone id as four bytes, big-endian, two's complement."""
    digits = F.lpad(F.hex(zone_id.cast("bigint")), 16, "0")
    return F.unhex(F.substring(digits, 9, 8))


def price_update_json() -> Column:
    return F.to_json(F.struct(*PRICE_UPDATE_FIELDS))
