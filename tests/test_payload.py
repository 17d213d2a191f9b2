from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ridetide.functions import contracts, enums, payload
from ridetide.functions.wire import price_update_json, zone_key
from ridetide.operators.normalize import (
    HEARTBEAT,
    RIDE,
    check_contract,
    decode_price_updates,
    normalize,
    quarantine,
    to_table_types,
)
from ridetide.schemas import PRICE_UPDATE
from ridetide.session import session_conf

ZONES = {
    "7": 7,
    '"7"': 7,
    '" 7 "': 7,
    "3.9": 3,
    '"3.9"': 3,
    "-3.9": -3,
    "1e3": 1000,
    '"x"': 0,
    '""': 0,
    '{"a":1}': 0,
    "[1]": 0,
    "null": 0,
    "true": 1,
    '"true"': 0,
    "false": 0,
    "4294967303": 7,
    "-4294967289": 7,
    "18446744073709551623": 7,
    "-18446744073709551609": 7,
    '"18446744073709551623"': 7,
    "9999999999999999999": (9999999999999999999 + 2**31) % 2**32 - 2**31,
    str(10**39 + 7): 7,
    str(-(10**39) - 7): -7,
    str(10**45 + 2**31): -(2**31),
    "1e12": 2147483647,
    "-1e12": -2147483648,
}


def raw(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value STRING")


@pytest.mark.parametrize("kind", [RIDE, HEARTBEAT])
def test_zone_coercion(spark, kind):
    values = {f'{{"zone_id":{text},"ts_event":5,"status":"AVAILABLE"}}': zone for text, zone in ZONES.items()}
    rows = normalize(raw(spark, values), kind, carry=("value",)).collect()
    assert {r.value: r.zone_id for r in rows} == values


DROPPED = {
    '{"ts_event":5}': "missing zone_id",
    '{"zone_id":7}': "missing ts_event",
    '{"Zone_Id":7,"ts_event":5}': "missing zone_id",
    "{bad": "unparsable",
    '{"zone_id":7,"ts_event":5': "unparsable",
    "": "unparsable",
    '[{"zone_id":7,"ts_event":5}]': "unparsable",
    "5": "unparsable",
    "null": "unparsable",
    "{'zone_id':7,'ts_event':5}": "unparsable",
    '{"zone_id":NaN,"ts_event":5}': "unparsable",
    '{"zone_id":7,"ts_event":9223372036854775807}': "ts_event out of range",
}
KEPT = ['{"zone_id":7,"ts_event":5} trailing', ' \n{"zone_id":7,"ts_event":null}', '{"zone_id":1,"zone_id":7,"ts_event":5}']


def test_refused_payloads_and_reasons(spark):
    values = raw(spark, [*DROPPED, *KEPT, None])
    kept = {r.value: r.zone_id for r in normalize(values, RIDE, carry=("value",)).collect()}
    assert kept == dict.fromkeys(KEPT, 7)
    refused = {r.value: r.reason for r in quarantine(values, RIDE).collect()}
    assert refused == {**DROPPED, None: "unparsable"}


def test_heartbeat_needs_a_status_and_keeps_any(spark):
    values = raw(
        spark,
        [
            '{"zone_id":1,"ts_event":5}',
            '{"zone_id":1,"ts_event":5,"status":"available"}',
            '{"zone_id":1,"ts_event":5,"status":null}',
        ],
    )
    assert sorted(r.status for r in normalize(values, HEARTBEAT).collect()) == ["available", "null"]
    assert [r.reason for r in quarantine(values, HEARTBEAT).collect()] == ["missing status"]


def test_parsed_once(spark):
    plan = normalize(raw(spark, ["{}"]), RIDE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def test_observed_counts(spark):
    seen = spark.createDataFrame([("{bad",), ('{"zone_id":1,"ts_event":2}',)], "value STRING")
    from pyspark.sql import Observation

    counts = Observation("rides")
    normalize(seen, RIDE, counted=counts).collect()
    assert counts.get == {"received": 2, "refused": 1}


UPDATE = (3, 10_000, 15_000, 5, 2, 2.5, 4.75, 15_000)


def test_wire_round_trip(spark):
    updates = spark.createDataFrame([UPDATE, (-2, -5_000, 0, 0, 0, 0.0, 1.0, 0)], PRICE_UPDATE)
    wire = updates.select(F.hex(zone_key(F.col("zone_id"))).alias("key"), price_update_json().alias("value"))
    rows = wire.collect()
    assert [r.key for r in rows] == ["00000003", "FFFFFFFE"]
    assert rows[0].value == (
        '{"zone_id":3,"window_start":10000,"window_end":15000,"demand":5,"supply":2,'
        '"ratio":2.5,"surge_multiplier":4.75,"ts_compute":15000}'
    )
    assert decode_price_updates(wire).collect() == updates.collect()


@pytest.mark.parametrize("value", ["{bad", "[]", '{"zone_id":1}', None])
def test_unusable_price_update_fails(spark, value):
    good = json.dumps(dict(zip(("zone_id window_start window_end demand supply ratio surge_multiplier ts_compute").split(), UPDATE)))
    with pytest.raises(Exception, match="unusable price update"):
        decode_price_updates(raw(spark, [good, value])).select("zone_id").collect()


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("ratio", [1e21, float("inf"), float("nan")])
def test_ratio_beyond_the_table_type_fails(spark, ansi, ratio):
    updates = spark.createDataFrame([(1, 0, 5, 2_000_000, 1, ratio, 7.0, 5)], PRICE_UPDATE)
    with session_conf(spark, {"spark.sql.ansi.enabled": ansi}):
        with pytest.raises(Exception, match="out of range for decimal"):
            to_table_types(updates).collect()


def test_contract_rules(spark):
    ride = {
        "event_id": "550e8400-e29b-41d4-a716-446655440000",
        "rider_id": "6ba7b810-9dad-11d1-80b4-00c04fd430c8",
        "zone_id": 15,
        "est_distance_km": 8.5,
        "est_duration_min": 18,
        "payment_type": "CARD",
        "ts_event": 1703098800000,
    }
    cases = {
        json.dumps(ride): [],
        json.dumps({**ride, "zone_id": 15.0}): [],
        json.dumps({**ride, "zone_id": 15.5}): ["zone_id:type"],
        json.dumps({**ride, "zone_id": "15"}): ["zone_id:type"],
        json.dumps({**ride, "zone_id": None}): ["zone_id:type"],
        json.dumps({**ride, "zone_id": 0}): ["zone_id:minimum"],
        json.dumps({**ride, "zone_id": 65}): ["zone_id:maximum"],
        json.dumps({**ride, "est_distance_km": -0.5}): ["est_distance_km:minimum"],
        json.dumps({**ride, "payment_type": "card"}): ["payment_type:enum"],
        json.dumps({**ride, "event_id": "event-01-000001"}): ["event_id:format"],
        json.dumps({**ride, "extra": {"a": 1}}): ["extra:additional"],
        json.dumps({k: v for k, v in ride.items() if k != "rider_id"}): ["rider_id:required"],
        "[1]": ["payload:type"],
        "{bad": ["payload:type"],
    }
    rows = check_contract(raw(spark, cases), contracts.RIDE_REQUEST).collect()
    assert {r.value: r.violations for r in rows} == cases


def test_long_numbers_keep_their_low_64_bits(spark):
    times = [2**63, 2**64 + 5, -(2**64) - 5, 10**80 + 3, -(2**63) - 1, 12345678901234567890123]
    values = [f'{{"zone_id":1,"ts_event":{time}}}' for time in times]
    fields = payload.parse_object(F.col("value"), ("ts_event",))
    got = raw(spark, values).select(payload.as_long(fields, "ts_event", F.col("value"))).collect()
    assert [row[0] for row in got] == [(time + 2**63) % 2**64 - 2**63 for time in times]


FOURTH = """{"title": "A refund", "type": "object", "properties": {
  "refund_id": {"type": "string", "pattern": "^R[0-9]+", "minLength": 3, "maxLength": 5},
  "cents": {"type": "integer", "exclusiveMinimum": 0, "maximum": 900, "multipleOf": 5},
  "share": {"type": ["number", "null"], "minimum": 0, "exclusiveMaximum": 1},
  "level": {"type": "integer", "enum": [1, 2, 5]},
  "kind": {"const": "full", "type": "string"},
  "open": {"type": "boolean"}, "notes": {"type": "array"}, "by": {"type": "object"}},
  "required": ["refund_id", "cents"]}"""


def test_a_contract_compiled_from_a_schema_text(spark):
    good = {"refund_id": "R12", "cents": 5}
    cases = {
        json.dumps(good): [],
        json.dumps({**good, "share": None, "level": 5, "kind": "full", "open": False, "notes": [1], "by": {}, "more": 1}): [],
        json.dumps({**good, "refund_id": "xR12"}): ["refund_id:pattern"],
        json.dumps({**good, "refund_id": "R1"}): ["refund_id:minLength"],
        json.dumps({**good, "refund_id": "R12345"}): ["refund_id:maxLength"],
        json.dumps({**good, "cents": 0}): ["cents:exclusiveMinimum"],
        json.dumps({**good, "cents": 901}): ["cents:maximum"],
        json.dumps({**good, "cents": 7}): ["cents:multipleOf"],
        json.dumps({**good, "share": 1}): ["share:exclusiveMaximum"],
        json.dumps({**good, "share": -0.5}): ["share:minimum"],
        json.dumps({**good, "share": "1"}): ["share:type"],
        json.dumps({**good, "level": 3}): ["level:enum"],
        json.dumps({**good, "kind": "part"}): ["kind:enum"],
        json.dumps({**good, "open": 1, "notes": {}, "by": []}): ["by:type", "notes:type", "open:type"],
        "{}": ["cents:required", "refund_id:required"],
    }
    rows = check_contract(raw(spark, cases), contracts.compile_schema(FOURTH)).collect()
    assert {r.value: r.violations for r in rows} == cases


@pytest.mark.parametrize(
    "schema",
    [
        {"type": "array"},
        {"type": "object", "patternProperties": {}},
        {"type": "object", "required": ["a"]},
        {"type": "object", "additionalProperties": {"type": "string"}},
        {"type": "object", "properties": {"a": {}}},
        {"type": "object", "properties": {"a": {"type": ["string", "number"]}}},
        {"type": "object", "properties": {"a": {"type": "string", "minimum": 1}}},
        {"type": "object", "properties": {"a": {"type": "integer", "enum": ["x"]}}},
        {"type": "object", "properties": {"a": {"type": "string", "format": "date"}}},
    ],
)
def test_what_cannot_be_checked_is_no_contract(schema):
    with pytest.raises(ValueError):
        contracts.compile_schema(schema)


def test_price_contract_flags_surge_above_three(spark):
    updates = spark.createDataFrame([UPDATE], PRICE_UPDATE).select(price_update_json().alias("value"))
    assert check_contract(updates, contracts.PRICE_UPDATE).first().violations == ["surge_multiplier:maximum"]


def test_enum_names(spark):
    names = spark.createDataFrame([("ride",), ("Heartbeat",)], "n STRING")
    assert [r[0] for r in names.select(enums.parse_event_kind(F.col("n"))).collect()] == ["RIDE", "HEARTBEAT"]
    with pytest.raises(Exception, match="unknown heartbeat status: idle"):
        spark.range(1).select(enums.parse_heartbeat_status(F.lit("idle"))).collect()
