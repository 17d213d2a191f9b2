"""Reading fields from JSON payloads with lenient number coercion.

A payload is parsed once, to the texts of the wanted fields only. A field that comes out null is
either missing (the payload is refused) or an explicit null (read as zero); only then are the keys
of the payload looked up.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNPARSED = "__unparsed"

# Strict JSON: Spark's reader is more permissive by default.
JSON_OPTIONS = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "columnNameOfCorruptRecord": _UNPARSED,
}

INT_MIN, INT_MAX = -(2**31), 2**31 - 1
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1

# Milliseconds a TIMESTAMP (microseconds in 64 bits) can hold.
TIMESTAMP_MAX_MS = LONG_MAX // 1000


def parse_object(value: Column, names: tuple[str, ...]) -> Column:
    """JSON text -> struct of field texts. Use ``is_object`` before trusting it."""
    fields = "".join(f"{name} STRING, " for name in names)
    return F.from_json(value, f"{fields}{_UNPARSED} STRING", JSON_OPTIONS)


def is_object(fields: Column, value: Column) -> Column:
    """True when the text is a whole JSON object; the parser alone would also accept an array."""
    whole = fields[_UNPARSED].isNull() & value.rlike("^\\s*\\{")
    return F.coalesce(whole, F.lit(False))


def has_field(fields: Column, value: Column, name: str) -> Column:
    """True when the object has the key, also with an explicit null."""
    named = F.coalesce(F.array_contains(F.json_object_keys(value), name), F.lit(False))
    # A CASE, not an OR: Spark evaluates repeated parts of an OR ahead, for every row.
    return F.when(fields[name].isNotNull(), F.lit(True)).otherwise(named)


def is_usable(fields: Column, value: Column, names: tuple[str, ...]) -> Column:
    usable = is_object(fields, value)
    for name in names:
        usable = usable & has_field(fields, value, name)
    return usable


def as_text(fields: Column, name: str) -> Column:
    return F.coalesce(fields[name], F.lit("null"))


def as_int(fields: Column, name: str, value: Column) -> Column:
    """Whole number from a number or text, else 0; fractions are cut.

    A whole number beyond 32 bits, of any length, keeps its low 32 bits, a fractional one the nearest bound.
    """
    text = fields[name]
    low_bits = (F.pmod(_whole(text), F.lit(2**32)) + F.lit(2**31)) % F.lit(2**32) - F.lit(2**31)
    return F.coalesce(
        low_bits, _low_bits(text, 32), _cut(text, INT_MIN, INT_MAX), _bare_true(text, name, value), F.lit(0)
    ).cast("int")


def as_long(fields: Column, name: str, value: Column) -> Column:
    """As ``as_int`` with 64 bits."""
    text = fields[name]
    return F.coalesce(
        _whole(text), _low_bits(text, 64), _cut(text, LONG_MIN, LONG_MAX), _bare_true(text, name, value), F.lit(0)
    )


def as_double(fields: Column, name: str, value: Column) -> Column:
    return F.coalesce(fields[name].try_cast("double"), F.lit(0.0))


# A failing cast costs a hundred times a successful one, so the shape is checked first.
_WHOLE_SHAPE = "^\\s*[+-]?[0-9]{1,19}\\s*$"
_REAL_SHAPE = "^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+|Infinity)([eE][+-]?[0-9]+)?\\s*$"


def _whole(text: Column) -> Column:
    return F.when(text.rlike(_WHOLE_SHAPE), text.try_cast("bigint"))


_LONG_SHAPE = "^\\s*[+-]?[0-9]{19,}\\s*$"
_GROUP = 9


def _low_bits(text: Column, bits: int) -> Column:
    """The low bits, as a signed number, of a whole number of any length: its digits are read from the left in
    groups, and what stands before a group counts modulo 2**bits."""
    wide = "decimal(38,0)"
    modulus = F.lit(Decimal(2**bits)).cast(wide)
    digits = F.regexp_extract(text, "([0-9]+)", 1)
    groups = F.ceil(F.length(digits) / F.lit(_GROUP)).cast("int")
    padded = F.lpad(digits, groups * _GROUP, "0")
    parts = F.transform(
        F.sequence(F.lit(0), groups - 1), lambda n: F.substring(padded, n * F.lit(_GROUP) + 1, F.lit(_GROUP)).cast(wide)
    )

    def add(before: Column, part: Column) -> Column:
        return ((before.cast("decimal(20,0)") * F.lit(Decimal(10**_GROUP)) + part) % modulus).cast(wide)

    size = F.aggregate(parts, F.lit(Decimal(0)).cast(wide), add)
    signed = F.when(text.rlike("^\\s*-"), -size).otherwise(size)
    half = F.lit(Decimal(2 ** (bits - 1))).cast(wide)
    low = F.pmod((signed + half).cast(wide), modulus) - half
    return F.when(text.rlike(_LONG_SHAPE), low.cast("bigint"))


def _cut(text: Column, low: int, high: int) -> Column:
    real = F.when(text.rlike(_REAL_SHAPE), text.try_cast("double"))
    return (
        F.when(real >= F.lit(float(high)), F.lit(high).cast("bigint"))
        .when(real <= F.lit(float(low)), F.lit(low).cast("bigint"))
        .when(real.isNotNull(), real.try_cast("bigint"))
    )


def _bare_true(text: Column, name: str, value: Column) -> Column:
    """1 for a bare JSON true; the quoted text is no number."""
    is_true = (text == "true") & value.rlike(f'"{name}"\\s*:\\s*true')
    return F.when(is_true, F.lit(1).cast("bigint"))
