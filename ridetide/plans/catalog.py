"""All registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Instants leave as epoch milliseconds, so that every engine types them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridetide.functions import contracts, enums, wire
from ridetide.functions.fare import with_reference_fare
from ridetide.functions.instants import to_millis
from ridetide.functions.wire import zone_key
from ridetide.operators import feeds, history, latest, normalize, pricing, stats, validate, windows
from ridetide.operators.lookup import zone_row
from ridetide.params import READ_ZONES, PricingParams
from ridetide.plans import inputs, streams
from ridetide.session import shared_dir
from ridetide.sources import tables
from ridetide.sources.fares import band_zones, build_fare_table
from ridetide.sources.seeds import seed_snapshot
from ridetide.streaming import job

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def in_millis(rows: DataFrame) -> DataFrame:
    """All TIMESTAMP columns as epoch milliseconds."""
    times = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return rows.withColumns({name: to_millis(F.col(name)) for name in times}) if times else rows


def _updates(spark, sf_dir) -> DataFrame:
    return windows.price_updates(inputs.events(spark, sf_dir), inputs.WINDOW_MS)


def _history(spark, sf_dir) -> DataFrame:
    return normalize.to_table_types(_updates(spark, sf_dir))


def _history_between(spark, sf_dir) -> DataFrame:
    events = inputs.events_between(spark, sf_dir, inputs.FROM_MS, inputs.TO_MS)
    return normalize.to_table_types(windows.price_updates(events, inputs.WINDOW_MS))


def _snapshot(spark, sf_dir) -> DataFrame:
    return latest.snapshot_of_history(_history(spark, sf_dir), inputs.AS_OF_MS)


# Normalisation and contracts


@query
def normalize_events(spark, sf_dir):
    return inputs.events(spark, sf_dir)


@query
def normalize_json(spark, sf_dir):
    rides, beats = inputs.payloads(spark, sf_dir)
    return normalize.union_events(
        normalize.normalize(rides, normalize.RIDE, carry=("event_id",)),
        normalize.normalize(beats, normalize.HEARTBEAT, carry=("event_id",)),
    )


@query
def normalize_damaged_json(spark, sf_dir):
    rides, beats = inputs.damaged_payloads(spark, sf_dir)
    return normalize.union_events(
        normalize.normalize(rides, normalize.RIDE, carry=("event_id",)),
        normalize.normalize(beats, normalize.HEARTBEAT, carry=("event_id",)),
    )


@query
def quarantine_events(spark, sf_dir):
    rides, beats = inputs.damaged_payloads(spark, sf_dir)
    refused = normalize.union_events(
        normalize.quarantine(rides, normalize.RIDE), normalize.quarantine(beats, normalize.HEARTBEAT)
    )
    return refused.select("event_id", "reason")


@query
def contract_violations(spark, sf_dir):
    rides, beats = inputs.contract_payloads(spark, sf_dir)
    checked = normalize.check_contract(rides, contracts.RIDE_REQUEST).unionByName(
        normalize.check_contract(beats, contracts.DRIVER_HEARTBEAT)
    )
    return checked.select("event_id", F.array_join("violations", ",").alias("violations"))


@query
def price_update_contract(spark, sf_dir):
    raw = inputs.broken_updates(_updates(spark, sf_dir))
    checked = normalize.check_contract(raw, contracts.PRICE_UPDATE)
    return checked.select("zone_id", "window_start", F.array_join("violations", ",").alias("violations"))


@query
def enum_parse(spark, sf_dir):
    events = inputs.events(spark, sf_dir)
    parsed = events.select(
        enums.parse_event_kind(F.lower("kind")).alias("kind"),
        F.when(F.col("status").isNotNull(), enums.parse_heartbeat_status(F.initcap("status"))).alias("status"),
    )
    return parsed.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("events"))


# Windows and prices


@query
def zone_demand_supply(spark, sf_dir):
    return windows.zone_demand_supply(inputs.events(spark, sf_dir), inputs.WINDOW_MS)


@query
def price_updates(spark, sf_dir):
    return _updates(spark, sf_dir)


@query
def price_updates_hourly(spark, sf_dir):
    return windows.price_updates(inputs.events(spark, sf_dir), 3_600_000)


@query
def price_updates_default_window(spark, sf_dir):
    return windows.price_updates(inputs.events(spark, sf_dir), PricingParams().window_ms)


@query
def price_updates_from_json(spark, sf_dir):
    rides, beats = inputs.damaged_payloads(spark, sf_dir)
    events = normalize.union_events(
        normalize.normalize(rides, normalize.RIDE), normalize.normalize(beats, normalize.HEARTBEAT)
    )
    return windows.price_updates(events, inputs.WINDOW_MS)


@query
def price_update_json(spark, sf_dir):
    return _updates(spark, sf_dir).select(
        F.hex(zone_key(F.col("zone_id"))).alias("key_hex"), wire.price_update_json().alias("value")
    )




@query
def price_update_decode(spark, sf_dir):
    raw = _updates(spark, sf_dir).select(wire.price_update_json().alias("value"))
    return in_millis(normalize.to_table_types(normalize.decode_price_updates(raw)))


# Tables


@query
def zone_window_metrics(spark, sf_dir):
    return in_millis(_history(spark, sf_dir))


@query
def zone_window_metrics_extreme(spark, sf_dir):
    """Windows with demand in the millions per driver."""
    counts = windows.zone_demand_supply(inputs.events(spark, sf_dir), inputs.WINDOW_MS)
    crowded = counts.withColumn("demand", F.col("demand") * F.lit(inputs.CROWD))
    return in_millis(normalize.to_table_types(windows.to_price_updates(crowded)))


@query
def zone_price_snapshot(spark, sf_dir):
    return in_millis(_snapshot(spark, sf_dir))


@query
def snapshot_over_seed(spark, sf_dir):
    """The snapshot at instants from a quarter of an hour on: seed rows until their zone gets a price."""
    updates = windows.price_updates(inputs.events(spark, sf_dir), PricingParams().window_ms)
    priced = latest.with_seed(normalize.to_table_types(updates), seed_snapshot(spark, inputs.FIRST_MS))
    instant = F.lit(inputs.FIRST_MS) + F.lit(inputs.INSTANT_MS) * F.expr("shiftleft(1L, cast(id % 64 as int))")
    asked = (
        spark.range(64 * (READ_ZONES[1] + 1))
        .where(f"id % 64 < {inputs.INSTANTS} and id >= 64")
        .select(F.floor(F.col("id") / 64).cast("int").alias("zone_id"), instant.alias("as_of"))
    )
    rows = latest.snapshot_as_of(asked, priced, "as_of", inputs.DAY_MS)
    return in_millis(rows)


@query
def fare_table(spark, sf_dir):
    """A row for every zone of a band, with the number of events seen there."""
    fares = build_fare_table(band_zones(spark), seed=1, created_ms=inputs.AS_OF_MS)
    seen = inputs.events(spark, sf_dir).groupBy("zone_id").agg(F.count(F.lit(1)).alias("events"))
    rows = fares.drop("created_at", "updated_at").join(seen, "zone_id", "left")
    return rows.withColumn("events", F.coalesce("events", F.lit(0).cast("bigint")))


# Read queries


@query
def history_range(spark, sf_dir):
    rows = history.history_range(_history_between(spark, sf_dir), inputs.FROM_MS, inputs.TO_MS)
    return in_millis(rows)


@query
def history_recent(spark, sf_dir):
    return in_millis(history.history_recent(_history(spark, sf_dir)))


@query
def history_full(spark, sf_dir):
    return in_millis(history.history_full(_history(spark, sf_dir)))


def _flat_rollup(rollup: DataFrame) -> DataFrame:
    """Responses with their list as text, one entry per window, newest first."""
    entry = F.transform(
        "metrics",
        lambda m: F.concat_ws(
            ":",
            F.unix_millis(m["window_start"]).cast("string"),
            F.unix_millis(m["computed_at"]).cast("string"),
            m["demand"].cast("string"),
            m["supply"].cast("string"),
            m["ratio"].cast("string"),
            m["surge_multiplier"].cast("string"),
        ),
    )
    flat = in_millis(rollup).withColumn("metrics", F.array_join(entry, ","))
    return flat.withColumnsRenamed({"from": "from_ms", "to": "to_ms"})


@query
def history_rollup(spark, sf_dir):
    return _flat_rollup(history.rollup_recent(history.history_recent(_history(spark, sf_dir))))


@query
def history_rollup_range(spark, sf_dir):
    rollup = history.rollup_range(
        _history_between(spark, sf_dir), inputs.FROM_MS, inputs.TO_MS, inputs.WINDOW_MS, page_windows=12
    )
    return _flat_rollup(rollup)


def _zone_response(spark, sf_dir, zone_id, **bounds) -> DataFrame:
    rows = _history(spark, sf_dir)
    return _flat_rollup(history.zone_history(rows, zone_id, inputs.WINDOW_MS, as_of_ms=inputs.AS_OF_MS, **bounds))


@query
def zone_history_recent(spark, sf_dir):
    return _zone_response(spark, sf_dir, inputs.HISTORY_ZONE)


@query
def zone_history_since(spark, sf_dir):
    """Up to now."""
    return _zone_response(spark, sf_dir, inputs.HISTORY_ZONE, from_ms=inputs.FROM_MS)


@query
def zone_history_until(spark, sf_dir):
    """From a day before."""
    return _zone_response(spark, sf_dir, inputs.HISTORY_ZONE, to_ms=inputs.TO_MS)


@query
def zone_history_empty(spark, sf_dir):
    """A day before the first event: a response with an empty list."""
    return _zone_response(spark, sf_dir, inputs.HISTORY_ZONE, to_ms=inputs.DAY_MS)


@query
def audit_topk(spark, sf_dir):
    return history.audit_records(_history(spark, sf_dir))


@query
def audit_count(spark, sf_dir):
    return history.with_count(history.audit_records(_history(spark, sf_dir)))


@query
def zones_listing(spark, sf_dir):
    return in_millis(history.zones_listing(_snapshot(spark, sf_dir)))


@query
def zones_count(spark, sf_dir):
    return history.with_count(history.zones_listing(_snapshot(spark, sf_dir)))


@query
def surge_only_zones(spark, sf_dir):
    return in_millis(history.surge_only(_snapshot(spark, sf_dir)))


def _flat_metrics(metrics: DataFrame) -> DataFrame:
    entries = F.transform(
        F.array_sort(F.map_entries("surge_distribution")),
        lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")),
    )
    return metrics.withColumn("surge_distribution", F.array_join(entries, ","))


@query
def fleet_metrics(spark, sf_dir):
    return _flat_metrics(stats.fleet_metrics(_snapshot(spark, sf_dir)))


@query
def surge_histogram(spark, sf_dir):
    return stats.surge_histogram(_snapshot(spark, sf_dir))


@query
def surge_histogram_windows(spark, sf_dir):
    """The same buckets over all windows of the history."""
    return stats.surge_histogram(_history(spark, sf_dir))


# Prices and quotes


@query
def zone_prices(spark, sf_dir):
    prices = pricing.zone_prices(
        inputs.price_requests(spark, sf_dir),
        _snapshot(spark, sf_dir),
        inputs.sample_fares(spark),
        inputs.AS_OF_MS,
        carry=("request_id",),
    )
    return in_millis(prices)


@query
def zone_prices_from_tables(spark, sf_dir):
    """As ``zone_prices``, from stored snapshot and fare tables."""
    folder = shared_dir(spark, "tables")
    _snapshot(spark, sf_dir).write.parquet(f"{folder}/snapshot")
    inputs.sample_fares(spark).write.parquet(f"{folder}/fares")
    prices = pricing.zone_prices(
        inputs.price_requests(spark, sf_dir),
        tables.zone_price_snapshot(spark, f"{folder}/snapshot"),
        tables.fare_config(spark, f"{folder}/fares"),
        inputs.AS_OF_MS,
        carry=("request_id",),
    )
    return in_millis(prices)


@query
def zones_listing_from_tables(spark, sf_dir):
    """The zone listing over a stored window table."""
    folder = shared_dir(spark, "metrics")
    _history(spark, sf_dir).write.parquet(folder)
    snapshot = latest.snapshot_of_history(tables.zone_window_metrics(spark, folder), inputs.AS_OF_MS)
    return in_millis(history.zones_listing(snapshot))


@query
def zone_prices_wide(spark, sf_dir):
    """Prices for zones 1..64: those above 16 have no snapshot and so no fare."""
    prices = pricing.zone_prices(
        inputs.price_requests(spark, sf_dir),
        _snapshot(spark, sf_dir),
        inputs.sample_fares(spark),
        inputs.AS_OF_MS,
        zones=(1, inputs.REQUEST_ZONES),
        carry=("request_id",),
    )
    return in_millis(prices)


@query
def zone_requests_rejected(spark, sf_dir):
    _, rejected = validate.guard_zones(inputs.price_requests(spark, sf_dir))
    return rejected


@query
def quotes(spark, sf_dir):
    answered = pricing.quotes(
        inputs.quote_requests(spark, sf_dir),
        _snapshot(spark, sf_dir),
        inputs.sample_fares(spark),
        inputs.AS_OF_MS,
        carry=("request_id",),
    )
    return in_millis(answered)


@query
def quotes_rejected(spark, sf_dir):
    return validate.rejected_quotes(inputs.quote_requests(spark, sf_dir))


@query
def reference_fares(spark, sf_dir):
    """Fare before surge of every valid request."""
    requests = validate.valid_quotes(inputs.quote_requests(spark, sf_dir)).withColumnRenamed(
        "origin_zone_id", "zone_id"
    )
    fares = zone_row(inputs.sample_fares(spark), (1, inputs.REQUEST_ZONES), "updated_at", "fare", "zone_id")
    joined = requests.join(fares, "zone_id", "left")
    fared = with_reference_fare(joined, F.col("estimated_distance_km"), F.col("estimated_duration_min"))
    return fared.select("request_id", "reference_fare")


@query
def quotes_as_of(spark, sf_dir):
    """Each request priced by what was known at its own time."""
    answered = pricing.quotes_as_of(
        inputs.paced_requests(spark, sf_dir),
        _history(spark, sf_dir),
        inputs.fare_versions(spark),
        inputs.DAY_MS,
        carry=("request_id",),
    )
    return in_millis(answered)


# Feeds


def _feed_fields(feed: DataFrame) -> DataFrame:
    fields = "surge_multiplier DOUBLE, quoted_fare DOUBLE, updated_at STRING, demand BIGINT, supply BIGINT, ratio DOUBLE"
    return feed.select("zone_id", F.from_json("value", fields).alias("f")).select("zone_id", "f.*")


@query
def all_zones_feed(spark, sf_dir):
    return _feed_fields(feeds.all_zones_feed(_updates(spark, sf_dir), inputs.AS_OF_MS)).drop("quoted_fare")


@query
def zone_feed(spark, sf_dir):
    return _feed_fields(
        feeds.zone_feed(_updates(spark, sf_dir), inputs.subscriptions(spark, sf_dir), inputs.AS_OF_MS)
    )


# Streams


@query
def stream_price_updates(spark, sf_dir):
    return streams.published_updates(spark, sf_dir)


@query
def stream_final(spark, sf_dir):
    return streams.published_updates(spark, sf_dir, job.FINAL)


@query
def stream_final_union(spark, sf_dir):
    return streams.published_updates(spark, sf_dir, job.FINAL, job.UNION)


@query
def stream_exact(spark, sf_dir):
    return streams.published_updates(spark, sf_dir, job.EXACT)


@query
def stream_history(spark, sf_dir):
    return in_millis(streams.stored_history(spark, sf_dir))


@query
def stream_snapshot(spark, sf_dir):
    return in_millis(streams.stored_snapshot(spark, sf_dir))


@query
def stream_history_new_checkpoint(spark, sf_dir):
    return in_millis(streams.log_of_two_checkpoints(spark, sf_dir).history())


@query
def stream_snapshot_new_checkpoint(spark, sf_dir):
    return in_millis(streams.log_of_two_checkpoints(spark, sf_dir).snapshot())


@query
def stream_snapshot_late(spark, sf_dir):
    """Updates of older windows arrive last, and win."""
    return in_millis(streams.log_of_two_checkpoints(spark, sf_dir, late_first=True).snapshot())


@query
def stream_snapshot_late_by_time(spark, sf_dir):
    """Updates of older windows arrive last, and the newest window wins."""
    return in_millis(streams.log_of_two_checkpoints(spark, sf_dir, late_first=True).snapshot(by_event_time=True))


@query
def stream_json_history(spark, sf_dir):
    return in_millis(streams.consumed_history(spark, sf_dir))


@query
def stream_json_history_compacted(spark, sf_dir):
    return in_millis(streams.consumed_history_compacted(spark, sf_dir))


@query
def stream_zone_feed(spark, sf_dir):
    return _feed_fields(streams.consumed_feed(spark, sf_dir))


@query
def stream_quotes(spark, sf_dir):
    return in_millis(streams.streamed_quotes(spark, sf_dir))


@query
def stream_quotes_live(spark, sf_dir):
    """Requests and updates as two streams: the state of a zone is its current price."""
    return in_millis(streams.quotes_live(spark, sf_dir))


@query
def stream_snapshot_seeded(spark, sf_dir):
    """Seed rows as the first state, replaced zone by zone; read from the state after each slice."""
    return in_millis(streams.seeded_snapshot(spark, sf_dir))


@query
def stream_fleet_metrics(spark, sf_dir):
    """Statistics kept up to date by what each change takes back and adds."""
    return _flat_metrics(streams.fleet_after_updates(spark, sf_dir))


@query
def stream_history_recent(spark, sf_dir):
    """The newest windows of each zone as state, of which late firings replace some."""
    return in_millis(streams.recent_windows(spark, sf_dir))


@query
def stream_open_windows(spark, sf_dir):
    """What a stopped job still holds."""
    return streams.open_windows(spark, sf_dir)


@query
def stream_exact_sequence(spark, sf_dir):
    """Every firing: on time, again for late events, not at all for events that are too late."""
    return streams.firing_sequence(spark, sf_dir, job.EXACT, job.UNION)


@query
def stream_live_sequence(spark, sf_dir):
    """Rides lag; the slower stream's watermark counts and none of them is too late."""
    return streams.firing_sequence(spark, sf_dir, job.LIVE, job.STRICT, rides_lag=2)


@query
def stream_live_sequence_union(spark, sf_dir):
    """Rides lag; the heartbeats move the common watermark past them."""
    return streams.firing_sequence(spark, sf_dir, job.LIVE, job.UNION, rides_lag=2)


@query
def stream_refused_counts(spark, sf_dir):
    return streams.refused_counts(spark, sf_dir)


@query
def stream_quarantine(spark, sf_dir):
    return streams.quarantined(spark, sf_dir)


@query
def stream_ingested_updates(spark, sf_dir):
    """Prices from payloads that were parsed once, with the refused ones stored in the same run."""
    return streams.ingested_updates(spark, sf_dir)


@query
def stream_late_events(spark, sf_dir):
    """How many events came after their window had been given up."""
    return streams.late_events(spark, sf_dir)
