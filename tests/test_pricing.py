from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from ridetide.operators import latest, pricing, stats, validate
from ridetide.operators.lookup import zone_row
from ridetide.plans import inputs
from ridetide.schemas import FARE_CONFIG, QUOTE_REQUEST, ZONE_PRICE_SNAPSHOT
from ridetide.sources.fares import BANDS, RATE_TYPES, band_zones, build_fare_table
from ridetide.sources.seeds import seed_snapshot

NOW = inputs.AS_OF_MS


def snapshot(spark, rows):
    """rows: (zone, surge)"""
    full = [(z, Decimal(s), 5, 3, Decimal("1.6667")) for z, s in rows]
    schema = ZONE_PRICE_SNAPSHOT.split(", window_start")[0]
    times = {n: F.timestamp_millis(F.lit(1_000)) for n in ("window_start", "window_end", "updated_at")}
    return spark.createDataFrame(full, schema).withColumns(times).select(*latest.SNAPSHOT_COLUMNS)


def quote(spark, zone, km=None, minutes=None, snaps=()):
    requests = spark.createDataFrame([(zone, 1, km, minutes, None)], QUOTE_REQUEST)
    snaps = snapshot(spark, snaps) if snaps else snapshot(spark, [(99, "1.00")])
    return pricing.quotes(requests, snaps, inputs.sample_fares(spark), NOW).collect()


@pytest.mark.parametrize(
    ("zone", "km", "minutes", "surge", "fare"),
    [
        (1, None, None, "1.65", "45.47"),
        (1, 0.0, 0.0, None, "9.50"),
        (17, None, None, None, "24.50"),
        (4, 3.0, 3.0, None, "22.50"),
        (20, 3.0, 3.0, None, "16.80"),
        (40, None, None, None, "12.30"),
        (60, None, None, None, "35.00"),
    ],
)
def test_quote_goldens(spark, zone, km, minutes, surge, fare):
    (row,) = quote(spark, zone, km, minutes, [(zone, surge)] if surge else ())
    assert row.quoted_fare == Decimal(fare)
    assert row.surge_multiplier == Decimal(surge or "1")
    assert (row.demand, row.supply) == ((5, 3) if surge else (0, 0))


def test_quote_rounds_twice(spark):
    # 8.00 + 2.80 x 1.001 + 0.65 x 1 = 11.4528 -> 11.45; x 1.65 = 18.8925 -> 18.89 (once: 18.90)
    (row,) = quote(spark, 1, 1.001, 1.0, [(1, "1.65")])
    assert row.quoted_fare == Decimal("18.89")


def test_price_without_snapshot_has_no_fare(spark):
    asked = spark.createDataFrame([(1,), (2,), (0,), (17,), (None,)], "zone_id INT")
    prices = pricing.zone_prices(asked, snapshot(spark, [(1, "1.65")]), inputs.sample_fares(spark), NOW)
    rows = {r.zone_id: r for r in prices.collect()}
    assert sorted(rows) == [1, 2]
    assert rows[1].quoted_fare == Decimal("45.47") and rows[1].updated_at.second == 1
    assert (rows[2].quoted_fare, rows[2].surge_multiplier, rows[2].demand) == (None, Decimal("1.00"), 0)
    _, rejected = validate.guard_zones(asked)
    assert {r.zone_id for r in rejected.collect()} == {0, 17, None}


@pytest.mark.parametrize(
    ("request_row", "reason"),
    [
        ((None, 1, None, None, None), "origin_zone_id"),
        ((65, 1, None, None, None), "origin_zone_id"),
        ((1, None, None, None, None), "destination_zone_id"),
        ((1, 1, -0.1, None, None), "estimated_distance_km"),
        ((1, 1, 1e9, None, None), None),
        ((1, 1, None, 9.9e21, None), None),
        ((1, 1, 1e22, None, None), "estimated_distance_km too large"),
        ((1, 1, None, float("inf"), None), "estimated_duration_min too large"),
        ((1, 1, float("nan"), None, None), "estimated_distance_km"),
        ((1, 1, None, -1.0, None), "estimated_duration_min"),
        ((64, 1, 0.0, 0.0, None), None),
    ],
)
def test_quote_validation(spark, request_row, reason):
    requests = spark.createDataFrame([request_row], QUOTE_REQUEST)
    rejected = [r.reject_reason for r in validate.rejected_quotes(requests).collect()]
    assert rejected == ([reason] if reason else [])
    assert validate.valid_quotes(requests).count() == (0 if reason else 1)


@pytest.mark.parametrize(
    ("km", "minutes", "fare"),
    [
        (1e9, None, "2800000015.80"),
        (99_999_999.12345678, 0.1234567891234567, "280000005.63"),
        (2.5e21, 1e-9, "7000000000000000000008.00"),
    ],
)
def test_enormous_estimates_are_priced_exactly(spark, km, minutes, fare):
    """Zone 1: 8.00 and 2.80 a kilometre and 0.65 a minute, half-up on the exact sum."""
    requests = spark.createDataFrame([(1, 1, km, minutes, None)], QUOTE_REQUEST)
    (row,) = pricing.quotes(requests, snapshot(spark, []), inputs.sample_fares(spark), NOW).collect()
    exact = Decimal("8.00") + Decimal("2.80") * Decimal(repr(km)) + Decimal("0.65") * Decimal(repr(minutes or 12.0))
    assert row.quoted_fare == exact.quantize(Decimal("0.01"), ROUND_HALF_UP) == Decimal(fare)


def test_lookup_side_is_one_row_per_zone_whatever_the_table_holds(spark):
    once = inputs.sample_fares(spark)
    later = once.withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 1 DAY"))
    doubled = once.unionByName(later.withColumn("base_fare", F.col("base_fare") + 1).select(once.columns))
    (side,) = zone_row(doubled, (1, 1), "updated_at", "fare", "zone_id").collect()
    assert side.fare.base_fare == Decimal("9.00")
    (row,) = quote(spark, 1)
    requests = spark.createDataFrame([(1, 1, None, None, None)], QUOTE_REQUEST)
    assert pricing.quotes(requests, snapshot(spark, [(1, "1.00"), (1, "1.00")]), doubled, NOW).count() == 1


def test_requests_are_not_shuffled(spark, sf_dir):
    requests = inputs.quote_requests(spark, sf_dir)
    plan = pricing.quotes(requests, snapshot(spark, [(1, "1.65")]), inputs.sample_fares(spark), NOW)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text
    request_side = text[text.index("BroadcastHashJoin") :]
    assert "Exchange hashpartitioning(origin_zone_id" not in request_side


def test_wide_zone_ranges_are_not_forced_to_broadcast(spark):
    side = zone_row(snapshot(spark, [(1, "1.00")]), (1, 10_000_000), "updated_at", "s", "zone_id")
    assert "ResolvedHint" not in side._jdf.queryExecution().analyzed().toString()


def test_fare_table_bands(spark):
    fares = build_fare_table(band_zones(spark), seed=7)
    assert set(fares.columns) == {c.split()[0] for c in FARE_CONFIG.split(", ")}
    rows = {r.zone_id: r for r in fares.collect()}
    assert sorted(rows) == list(range(1, 17))
    for first, last, kind, rates in BANDS:
        for zone in range(first, last + 1):
            assert rows[zone].zone_type == kind and rows[zone].active
            for name in RATE_TYPES:
                low, width = map(Decimal, rates[name])
                assert low <= rows[zone][name] <= low + width
    again = build_fare_table(band_zones(spark).repartition(5), seed=7).drop("created_at", "updated_at")
    assert sorted(again.collect()) == sorted(fares.drop("created_at", "updated_at").collect())
    other = build_fare_table(band_zones(spark), seed=8).select("base_fare").collect()
    assert sorted(other) != sorted(r for r in fares.select("base_fare").collect())


def test_seed_snapshot(spark):
    rows = {r.zone_id: r for r in seed_snapshot(spark, 60_000).collect()}
    assert sorted(rows) == [1, 3, 6, 8, 10, 12, 14, 16]
    assert rows[6].surge_multiplier == Decimal("1.00") and rows[6].ratio == Decimal("0.5300")
    assert rows[1].window_start.second == 0 and (rows[1].window_end - rows[1].window_start).seconds == 14


def test_fleet_metrics(spark):
    rows = [(1, "1.00"), (2, "0.90"), (3, "1.49"), (4, "1.50"), (5, "2.00"), (6, "2.49"), (7, "2.50"), (8, "7.00")]
    (m,) = stats.fleet_metrics(snapshot(spark, rows)).collect()
    assert m.surge_distribution == {"normal": 1, "low": 2, "medium": 1, "high": 2, "extreme": 2}
    assert (m.message, m.active_zones, m.total_snapshots, m.total_demand, m.total_supply) == (None, 8, 8, 40, 24)
    assert (m.min_surge, m.max_surge) == (0.9, 7.0)
    assert m.average_surge == pytest.approx(18.88 / 8) and m.average_ratio == 40 / 24
    histogram = stats.surge_histogram(snapshot(spark, rows)).collect()
    assert {r.bucket: r.zones for r in histogram} == m.surge_distribution


def test_fleet_metrics_of_nothing(spark):
    empty = snapshot(spark, [(1, "1.00")]).limit(0)
    (m,) = stats.fleet_metrics(empty).collect()
    assert m.message == "No data available yet" and m.total_snapshots == 0
    assert {r.zones for r in stats.surge_histogram(empty).collect()} == {0}
