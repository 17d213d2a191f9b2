from __future__ import annotations

from datetime import timezone
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridetide.operators import history, latest
from ridetide.operators.feeds import all_zones_feed, zone_feed
from ridetide.operators.normalize import HEARTBEAT, RIDE, normalize, to_table_types, union_events
from ridetide.operators.windows import price_updates, zone_demand_supply
from ridetide.plans import inputs
from ridetide.schemas import NORMALIZED_EVENT, PRICE_UPDATE

SIZE = 5_000
SEED = 12_345


def events(spark, rows):
    return spark.createDataFrame(rows, NORMALIZED_EVENT)


def test_deterministic_generator_golden(spark):
    """Ride i at seed + 1000 i, heartbeat i at seed + 100 i, all available, in each zone."""
    zones = spark.range(1, 17).select(F.col("id").cast("int").alias("zone_id"))
    i = F.col("id")

    def payload(count, step, **more):
        ids = spark.range(1, count + 1)
        ts = (F.lit(SEED) + i * step).alias("ts_event")
        return zones.crossJoin(ids).select(
            F.to_json(F.struct("zone_id", ts, *[F.lit(v).alias(k) for k, v in more.items()])).alias("value")
        )

    rides = normalize(payload(30, 1_000), RIDE)
    beats = normalize(payload(300, 100, status="AVAILABLE"), HEARTBEAT)
    rows = price_updates(union_events(rides, beats), SIZE).collect()
    by_window = {(r.zone_id, r.window_start): r for r in rows}
    for zone in range(1, 17):
        first = by_window[zone, 10_000]
        assert (first.demand, first.supply, first.ratio) == (2, 26, 0.07692307692307693)
        for start in (15_000, 20_000, 25_000, 30_000, 35_000):
            r = by_window[zone, start]
            assert (r.demand, r.supply, r.ratio, r.surge_multiplier) == (5, 50, 0.1, 1.0)
            assert r.window_end == r.ts_compute == start + SIZE


def test_counting_rules(spark):
    rows = [
        ("RIDE", 1, 0, None),
        ("RIDE", 1, 4_999, None),
        ("RIDE", 1, 5_000, None),
        ("HEARTBEAT", 1, 1, "AVAILABLE"),
        ("HEARTBEAT", 1, 1, "available"),
        ("HEARTBEAT", 2, 1, "BUSY"),
        ("heartbeat", 2, 1, "AVAILABLE"),
        ("RIDE", 3, -1, None),
    ]
    got = {tuple(r) for r in zone_demand_supply(events(spark, rows), SIZE).collect()}
    assert got == {
        (1, 0, 5_000, 2, 1),
        (1, 5_000, 10_000, 1, 0),
        (2, 0, 5_000, 0, 0),
        (3, -5_000, 0, 1, 0),
    }


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["RIDE", "HEARTBEAT"]),
            st.integers(1, 3),
            st.integers(-20_000, 20_000),
            st.sampled_from(["AVAILABLE", "BUSY"]),
        ),
        min_size=1,
        max_size=60,
    )
)
def test_counts_against_brute_force(spark, rows):
    rows = [(k, z, t, None if k == "RIDE" else s) for k, z, t, s in rows]
    want: dict = {}
    for kind, zone, ts, status in rows:
        counts = want.setdefault((zone, ts // SIZE * SIZE), [0, 0])
        counts[0] += kind == "RIDE"
        counts[1] += status == "AVAILABLE"
    got = {(r.zone_id, r.window_start): [r.demand, r.supply] for r in price_updates(events(spark, rows), SIZE).collect()}
    assert got == want


def test_one_exchange_with_map_side_counts(spark, sf_dir):
    plan = price_updates(inputs.events(spark, sf_dir), inputs.WINDOW_MS)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "partial_count" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in text


def test_a_hot_zone_reaches_the_shuffle_pre_aggregated(spark):
    """Nine tenths of the rows in one zone: the exchange carries one row per task and window."""
    skewed = spark.range(0, 200_000, numPartitions=8).select(
        F.lit("RIDE").alias("kind"),
        F.when(F.col("id") % 10 < 9, 1).otherwise((F.col("id") % 16 + 2).cast("int")).alias("zone_id"),
        (F.col("id") % 10_000).alias("ts_event"),
        F.lit(None).cast("string").alias("status"),
    )
    counts = zone_demand_supply(skewed, SIZE)
    assert {r.demand for r in counts.filter("zone_id = 1").collect()} == {90_000}
    rows = counts.collect()
    assert sum(r.demand for r in rows) == 200_000
    graph = counts._jdf.queryExecution().executedPlan().toString()
    assert graph.index("partial_count") > graph.index("Exchange hashpartitioning")


def table(spark, rows):
    """rows: (zone, window_start in windows, demand)"""
    updates = [(z, w * SIZE, (w + 1) * SIZE, d, 1, float(d), 1.0, (w + 1) * SIZE) for z, w, d in rows]
    return to_table_types(spark.createDataFrame(updates, PRICE_UPDATE))


def ms(value) -> int:
    return int(value.replace(tzinfo=timezone.utc).timestamp() * 1000)


def starts(response) -> list[int]:
    return [ms(m.window_start) // SIZE for m in response.metrics]


def test_zone_history_branches(spark):
    stored = table(spark, [(1, w, w) for w in range(250)] + [(2, 0, 1)])
    (recent,) = history.zone_history(stored, 1, SIZE).collect()
    assert starts(recent) == list(range(249, 149, -1)) and recent.total_windows == 100
    assert (ms(recent["from"]), ms(recent["to"])) == (150 * SIZE, 250 * SIZE)

    (ranged,) = history.zone_history(stored, 1, SIZE, from_ms=10 * SIZE, to_ms=13 * SIZE + 1).collect()
    assert starts(ranged) == [12, 11, 10] and ranged.total_windows == 3

    (since,) = history.zone_history(stored, 1, SIZE, from_ms=248 * SIZE, as_of_ms=1_000 * SIZE).collect()
    assert starts(since) == [249, 248] and ms(since["to"]) == 1_000 * SIZE

    day = 86_400_000
    (until,) = history.zone_history(stored, 1, SIZE, to_ms=day + 5 * SIZE).collect()
    assert starts(until)[-1] == 5 and ms(until["from"]) == 5 * SIZE

    (nothing,) = history.zone_history(stored, 3, SIZE, as_of_ms=day).collect()
    assert (nothing.zone_id, nothing.total_windows, nothing.metrics) == (3, 0, [])
    assert (ms(nothing["from"]), ms(nothing["to"])) == (0, day)

    with pytest.raises(ValueError, match="zone_id not in 1..16"):
        history.zone_history(stored, 17, SIZE)


def test_long_ranges_come_in_pages_without_loss(spark):
    stored = table(spark, [(1, w, w) for w in range(25)] + [(2, 3, 1)])
    pages = history.rollup_range(stored, 0, 25 * SIZE, SIZE, page_windows=10).orderBy("zone_id", "page").collect()
    assert [(p.zone_id, p.page, p.page_windows, p.total_windows) for p in pages] == [
        (1, 0, 10, 25), (1, 1, 10, 25), (1, 2, 5, 25), (2, 2, 1, 1)
    ]
    assert sum((starts(p) for p in pages if p.zone_id == 1), []) == list(range(24, -1, -1))


def test_history_recent_limits_before_the_shuffle(spark):
    stored = table(spark, [(z, w, w) for z in (1, 2) for w in range(20)])
    rows = history.history_recent(stored, 3)
    assert sorted((r.zone_id, r.demand) for r in rows.collect()) == [(z, d) for z in (1, 2) for d in (17, 18, 19)]
    assert "WindowGroupLimit" in rows._jdf.queryExecution().executedPlan().toString()
    one = history.history_recent(stored, 3, zone_id=2).collect()
    assert [(r.zone_id, r.demand) for r in one] == [(2, 19), (2, 18), (2, 17)]
    assert [r.demand for r in history.history_full(stored, 1).collect()] == list(range(19, -1, -1))


def test_audit_order_and_texts(spark):
    stored = table(spark, [(2, 1, 7), (1, 1, 8), (1, 0, 9)])
    rows = [tuple(r) for r in history.audit_records(stored, 2).collect()]
    assert rows == [
        (1, "1970-01-01T00:00:05Z", "1970-01-01T00:00:10Z", 8, 1, 8.0, 1.0, "1970-01-01T00:00:10Z"),
        (2, "1970-01-01T00:00:05Z", "1970-01-01T00:00:10Z", 7, 1, 7.0, 1.0, "1970-01-01T00:00:10Z"),
    ]


LOG = "zone_id INT, window_start BIGINT, demand BIGINT, batch_id BIGINT, seq BIGINT"


def log(spark, rows):
    wide = spark.createDataFrame(rows, LOG).select(
        "zone_id", "window_start", (F.col("window_start") + SIZE).alias("window_end"), "demand",
        F.lit(1).cast("bigint").alias("supply"), F.lit(1.0).alias("ratio"), F.lit(1.0).alias("surge_multiplier"),
        (F.col("window_start") + SIZE).alias("ts_compute"), F.lit(1).cast("bigint").alias("run"), "batch_id", "seq",
    )
    return to_table_types(wide).withColumn("received_at", F.timestamp_millis("batch_id"))


def test_last_arrival_wins(spark):
    rows = log(
        spark,
        [
            (1, 0, 1, 0, 0), (1, 5_000, 2, 0, 0), (1, 0, 3, 1, 0),  # batch 1 corrects the older window
            (2, 0, 1, 0, 5), (2, 0, 4, 0, 6), (2, 0, 2, 0, 5),
        ],
    )
    kept = {(r.zone_id, ms(r.window_start)): r.demand for r in latest.history_of_log(rows).collect()}
    assert kept == {(1, 0): 3, (1, 5_000): 2, (2, 0): 4}
    by_arrival = {r.zone_id: (ms(r.window_start), r.demand) for r in latest.snapshot_of_log(rows).collect()}
    assert by_arrival == {1: (0, 3), 2: (0, 4)}
    by_time = {r.zone_id: (ms(r.window_start), r.demand) for r in latest.snapshot_of_log(rows, True).collect()}
    assert by_time == {1: (5_000, 2), 2: (0, 4)}


def test_snapshot_of_history_is_a_hash_aggregate(spark):
    stored = table(spark, [(1, 0, 1), (1, 3, 2), (2, 1, 5)])
    rows = latest.snapshot_of_history(stored, 9_000)
    assert sorted((r.zone_id, r.demand, ms(r.updated_at)) for r in rows.collect()) == [(1, 2, 9_000), (2, 5, 9_000)]
    assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()


def test_surge_only_and_listing(spark):
    stored = table(spark, [(1, 0, 1)]).unionByName(
        table(spark, [(2, 0, 1)]).withColumn("surge_multiplier", F.lit(Decimal("1.01")).cast("decimal(4,2)"))
    )
    snap = latest.snapshot_of_history(stored, 0)
    assert [r.zone_id for r in history.surge_only(snap).collect()] == [2]
    assert history.with_count(history.zones_listing(snap)).first()["count"] == 2


def test_feeds(spark):
    updates = spark.createDataFrame([(1, 0, 5_000, 4, 3, 4 / 3, 2.25, 5_000), (2, 0, 5_000, 0, 0, 0.0, 1.0, 5_000)], PRICE_UPDATE)
    everyone = {r.zone_id: r.value for r in all_zones_feed(updates, 1_500).collect()}
    assert everyone[1] == (
        '{"zone_id":1,"surge_multiplier":2.25,"demand":4,"supply":3,"ratio":1.3333333333333333,'
        '"updated_at":"1970-01-01T00:00:01.500Z"}'
    )
    subscriptions = spark.createDataFrame([(1,), (1,), (17,)], "zone_id INT")
    assert [tuple(r) for r in zone_feed(updates, subscriptions, 0).collect()] == [
        (
            1,
            '{"zone_id":1,"surge_multiplier":2.25,"quoted_fare":null,"updated_at":"1970-01-01T00:00:00Z",'
            '"demand":4,"supply":3,"ratio":1.3333333333333333}',
        )
    ]
