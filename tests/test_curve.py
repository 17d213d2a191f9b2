from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ridetide.functions.curve import demand_supply_ratio, surge_multiplier
from ridetide.functions.instants import RATIO_TYPE, SURGE_TYPE, iso_text, window_start_ms
from ridetide.session import session_conf

GOLDEN_SURGE = {
    0.0: 1.0, 0.1: 1.0, 0.5: 1.0, 0.53: 1.03, 0.65: 1.15, 0.8: 1.3, 1.0: 1.65, 1.2: 2.0, 1.5: 2.75,
    2.0: 4.0, 2.33: 4.495, 2.5: 4.75, 3.0: 5.5, 4.0: 6.25, 5.0: 7.0, 9.33: 7.0, 999.0: 7.0,
}
GOLDEN_RATIO = {
    (0, 0): 0.0, (0, 5): 0.0, (5, 0): 999.0, (1, 3): 0.3333333333333333, (4, 5): 0.8, (2000, 1): 2000.0,
}


def test_surge_goldens(spark):
    rows = spark.createDataFrame([(r,) for r in GOLDEN_SURGE], "ratio DOUBLE")
    got = {r.ratio: r.surge for r in rows.select("ratio", surge_multiplier(F.col("ratio")).alias("surge")).collect()}
    for ratio, surge in GOLDEN_SURGE.items():
        assert got[ratio] == pytest.approx(surge, abs=1e-12), ratio


def test_surge_is_monotone_continuous_and_bounded(spark):
    ratios = spark.range(0, 70_001).select((F.col("id") / 10_000).alias("r"))
    got = [r.s for r in ratios.select(surge_multiplier(F.col("r")).alias("s"), "r").orderBy("r").collect()]
    steps = [b - a for a, b in zip(got, got[1:])]
    assert min(steps) >= -1e-12 and max(steps) < 3e-4
    assert got[0] == 1.0 and got[-1] == 7.0


def test_ratio_goldens(spark):
    rows = spark.createDataFrame(list(GOLDEN_RATIO), "d BIGINT, s BIGINT")
    got = rows.select("d", "s", demand_supply_ratio(F.col("d"), F.col("s")).alias("r")).collect()
    assert {(r.d, r.s): r.r for r in got} == GOLDEN_RATIO


def test_table_decimals_round_half_up_from_the_text_of_the_double(spark):
    row = spark.range(1).select(
        F.lit(1.005).cast(SURGE_TYPE).alias("a"), (F.lit(1.0) / 3).cast(RATIO_TYPE).alias("b")
    ).first()
    assert (str(row.a), str(row.b)) == ("1.01", "0.3333")


def test_windows_are_epoch_aligned_also_before_1970(spark):
    rows = spark.createDataFrame([(13_345,), (15_000,), (-1,), (-5_000,)], "ms BIGINT")
    got = [r[0] for r in rows.select(window_start_ms(F.col("ms"), 5_000)).collect()]
    assert got == [10_000, 15_000, -5_000, -5_000]


def test_iso_text_is_utc_in_any_session(spark):
    with session_conf(spark, {"spark.sql.session.timeZone": "America/New_York"}):
        text = spark.range(1).select(iso_text(F.timestamp_millis(F.lit(1_704_067_200_000)))).first()[0]
    assert text == "2024-01-01T00:00:00Z"


def test_iso_text_writes_as_many_digits_as_needed(spark):
    micros = spark.createDataFrame([(0,), (1_000_000,), (1_500_000,), (1_000_001,)], "m BIGINT")
    ts = F.timestamp_micros("m")
    got = [tuple(r) for r in micros.select(iso_text(ts), iso_text(ts, always_seconds=False)).collect()]
    assert got == [
        ("1970-01-01T00:00:00Z", "1970-01-01T00:00Z"),
        ("1970-01-01T00:00:01Z", "1970-01-01T00:00:01Z"),
        ("1970-01-01T00:00:01.500Z", "1970-01-01T00:00:01.500Z"),
        ("1970-01-01T00:00:01.000001Z", "1970-01-01T00:00:01.000001Z"),
    ]
