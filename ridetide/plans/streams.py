"""Registered streaming queries. Each runs its streams over whole tables until they are read and
returns the resulting table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ridetide.operators.latest import last_by, snapshot_of_history
from ridetide.operators.normalize import HEARTBEAT, RIDE, decode_price_updates, to_table_types
from ridetide.operators.pricing import quotes
from ridetide.operators.windows import price_updates
from ridetide.params import PricingParams
from ridetide.plans import inputs
from ridetide.session import shared_dir
from ridetide.sources.seeds import seed_snapshot
from ridetide.sources.streams import Files, publish, raw_batch, raw_stream
from ridetide.streaming import job, live
from ridetide.streaming.consumer import consume, store_updates
from ridetide.streaming.losses import LATE_METRIC, Losses
from ridetide.streaming.store import UpdateLog

PARAMS = PricingParams(window_ms=inputs.WINDOW_MS)


def _run(spark: SparkSession, writer, folder: str, partitions: int | None = None) -> None:
    """Run a writer to its end, with so many partitions of the state, else as many as the session says."""
    settings = {"spark.sql.shuffle.partitions": str(partitions)} if partitions else None
    job.start(spark, writer, f"{folder}/checkpoint", settings=settings).awaitTermination()


def _last_updates(spark: SparkSession, published: Files) -> DataFrame:
    updates = decode_price_updates(raw_batch(spark, published), carry=("seq",))
    return last_by(updates, ("zone_id", "window_start"), "seq").drop("seq")


def published_updates(
    spark: SparkSession, sf_dir: str, mode: str = job.LIVE, idle_policy: str = job.STRICT
) -> DataFrame:
    """Pricing job to JSON files, then the last update of each zone and window."""
    folder = shared_dir(spark, f"updates-{mode}")
    stream = job.price_stream(*inputs.event_streams(spark, sf_dir), PARAMS, mode, idle_policy)
    sink = Files(f"{folder}/price-updates")
    _run(spark, publish(stream.updates, sink, stream.output_mode), folder)
    return _last_updates(spark, sink)


def _store(log: UpdateLog, events: tuple[DataFrame, DataFrame], checkpoint: str, run: int) -> None:
    stream = job.price_stream(*events, PARAMS)
    writer = store_updates(stream.updates, log, stream.output_mode, inputs.AS_OF_MS, run)
    job.start(events[0].sparkSession, writer, checkpoint).awaitTermination()


def _stored_log(spark: SparkSession, sf_dir: str) -> UpdateLog:
    folder = shared_dir(spark, "tables")
    log = UpdateLog(spark, f"{folder}/updates")
    _store(log, inputs.event_streams(spark, sf_dir), f"{folder}/checkpoint", 1)
    return log


def _halves(spark: SparkSession, sf_dir: str) -> tuple:
    """The event streams before and from the start of the range, which is the start of a window."""
    early = F.col("ts_event") < F.lit(inputs.FROM_MS)
    streams = inputs.event_streams(spark, sf_dir)
    return tuple(s.filter(early) for s in streams), tuple(s.filter(~early) for s in streams)


def log_of_two_checkpoints(spark: SparkSession, sf_dir: str, late_first: bool = False) -> UpdateLog:
    """Both halves of the events in one log, each under a checkpoint and in a run of its own.

    With ``late_first`` the newer half comes first, so that updates of older windows arrive last.
    """
    folder = shared_dir(spark, "checkpoints")
    log = UpdateLog(spark, f"{folder}/updates")
    halves = _halves(spark, sf_dir)
    for run, events in enumerate(reversed(halves) if late_first else halves):
        _store(log, events, f"{folder}/checkpoint-{run}", run)
    return log


def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_log(spark, sf_dir).history()


def stored_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_log(spark, sf_dir).snapshot()


def _consumed(spark: SparkSession, sf_dir: str) -> tuple[UpdateLog, str]:
    """Both jobs from raw JSON: payload files -> pricing job -> update files -> table job."""
    folder = shared_dir(spark, "json")
    for name, raw in zip(("rides", "heartbeats"), inputs.payloads(spark, sf_dir), strict=True):
        raw.select("value").write.mode("overwrite").text(f"{folder}/{name}")
    rides, heartbeats = (
        raw_stream(spark, Files(f"{folder}/{name}")).select("value") for name in ("rides", "heartbeats")
    )
    stream = job.price_stream_of_json(rides, heartbeats, PARAMS)
    published = Files(f"{folder}/price-updates")
    _run(spark, publish(stream.updates, published, stream.output_mode), f"{folder}/pricing")

    log, feeds = UpdateLog(spark, f"{folder}/updates"), f"{folder}/feeds"
    raw = raw_stream(spark, Files(published.path))
    subscribed = inputs.subscriptions(spark, sf_dir)
    _run(spark, consume(raw, log, inputs.AS_OF_MS, feeds, subscribed), f"{folder}/tables")
    return log, feeds


def consumed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consumed(spark, sf_dir)[0].history()


def consumed_history_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``consumed_history``, rewritten as a table partitioned by day."""
    log, _ = _consumed(spark, sf_dir)
    return log.rewrite(shared_dir(spark, "history")).drop("day")


def consumed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone feed records of the table job, one per update of a subscribed zone."""
    _, feeds = _consumed(spark, sf_dir)
    return spark.read.text(f"{feeds}/zones").select(F.col("zone_id").cast("int").alias("zone_id"), "value")


SEQUENCE_PARAMS = PricingParams(
    window_ms=inputs.WINDOW_MS, out_of_orderness_ms=inputs.DAY_MS, lateness_ms=inputs.DAY_MS
)


# State that is keyed by the sixteen zones alone needs no more partitions.
ZONE_PARTITIONS = 4

# Micro-batches in which the recent windows read what was published.
RECENT_BATCHES = 4


def play(
    spark: SparkSession,
    folder: str,
    sliced: dict[str, DataFrame],
    writer_of: Callable[..., DataStreamWriter],
    slices: int = inputs.SLICES,
    partitions: int | None = None,
) -> tuple[list[int | None], StreamingQuery]:
    """Streams whose micro-batches are the slices of tables (column ``slice``), in order; the last query.

    The tables are dealt to a folder per slice in one parallel job each. Then slice after slice is added
    to the folders of the streams, and the query goes on from its checkpoint until it has read it: one
    micro-batch, however many files it has. Only after the last slice it runs on without data.

    ``partitions`` of the state, where its keys are a few; else as many as the session says. Returns the number of the last micro-batch after each slice, as slices without rows have none of their own, and
    the last query.
    """
    done: list[int | None] = []
    for name, rows in sliced.items():
        rows.write.partitionBy("slice").parquet(f"{folder}/sliced-{name}")
    kinds = {name: rows.drop("slice").schema for name, rows in sliced.items()}
    for number in range(slices):
        for name, rows in sliced.items():
            staged = spark.read.schema(rows.schema).parquet(f"{folder}/sliced-{name}")
            staged.where(F.col("slice") == number).drop("slice").write.mode("append").parquet(f"{folder}/{name}")
        streams = [spark.readStream.schema(kind).parquet(f"{folder}/{name}") for name, kind in kinds.items()]
        last = str(number == slices - 1).lower()
        settings = {"spark.sql.streaming.noDataMicroBatches.enabled": last}
        if partitions:
            settings["spark.sql.shuffle.partitions"] = str(partitions)
        query = job.start(spark, writer_of(*streams), f"{folder}/checkpoint", settings=settings)
        query.awaitTermination()
        with_rows = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
        done.append(with_rows[-1] if with_rows else done[-1] if done else None)
    return done, query


def _fired(spark: SparkSession, sf_dir: str, mode: str, idle_policy: str, rides_lag: int) -> tuple[Files, StreamingQuery]:
    """The updates that a job publishes over slices of the events, one per micro-batch."""
    folder = shared_dir(spark, f"sequence-{mode}")
    events = inputs.sliced_events(spark, sf_dir, rides_lag)
    sliced = {kind: events.where(F.col("kind") == kind) for kind in (RIDE, HEARTBEAT)}
    sink = Files(f"{folder}/price-updates")

    def writer(rides: DataFrame, beats: DataFrame) -> DataStreamWriter:
        stream = job.price_stream(rides, beats, SEQUENCE_PARAMS, mode, idle_policy)
        return publish(stream.updates, sink, stream.output_mode, run=0)

    _, query = play(spark, folder, sliced, writer)
    return sink, query


def firing_sequence(spark: SparkSession, sf_dir: str, mode: str, idle_policy: str, rides_lag: int = 0) -> DataFrame:
    """Every update that a job emits over slices of the events, with the number of its micro-batch."""
    sink, _ = _fired(spark, sf_dir, mode, idle_policy, rides_lag)
    return decode_price_updates(raw_batch(spark, sink), carry=("seq",)).withColumnRenamed("seq", "batch")


def recent_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest windows of each zone, held as state, from updates of which many fire again late.

    There are as many files as micro-batches and partitions before. They are read in a fixed number of
    micro-batches, since each one costs the same however little it brings.
    """
    sink, _ = _fired(spark, sf_dir, job.LIVE, job.STRICT, 2)
    folder = shared_dir(spark, "recent")
    files = len(raw_batch(spark, sink).inputFiles())
    raw = raw_stream(spark, Files(sink.path, {"maxFilesPerTrigger": str(max(1, -(-files // RECENT_BATCHES)))}))
    changes = live.recent_stream(decode_price_updates(raw, carry=("seq",)))
    _run(spark, changes.writeStream.outputMode("update").format("noop"), folder, ZONE_PARTITIONS)
    return to_table_types(live.recent_table(spark, f"{folder}/checkpoint"))


def _sliced_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.sliced_updates(price_updates(inputs.events(spark, sf_dir), inputs.WINDOW_MS))


def quotes_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of a stream of requests by a stream of updates, both in slices and some of both late."""
    folder = shared_dir(spark, "quotes-live")
    sliced = {"requests": inputs.sliced_requests(spark, sf_dir), "updates": _sliced_updates(spark, sf_dir)}
    path = f"{folder}/quotes"
    kinds = []

    def writer(requests: DataFrame, updates: DataFrame) -> DataStreamWriter:
        quoted = live.live_quotes(requests, updates, inputs.sample_fares(spark))
        kinds.append(quoted.schema)
        # To the stateful step this is the update mode; the file sink takes what it emits.
        return quoted.writeStream.outputMode("update").foreachBatch(
            lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")
        )

    play(spark, folder, sliced, writer, inputs.LIVE_SLICES)
    return spark.read.schema(kinds[-1]).parquet(path).select(*kinds[-1].names)


def seeded_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot after each slice, as the state of a stream that begins with the seed rows."""
    folder = shared_dir(spark, "seeded")
    updates = price_updates(inputs.events(spark, sf_dir), PricingParams().window_ms)
    rows = updates.select(
        "*", F.col("ts_compute").alias("updated_at"), F.lit(0).cast("bigint").alias("seq"), inputs.seed_slice(F.col("ts_compute"))
    )
    seed = seed_snapshot(spark, inputs.FIRST_MS)

    def writer(updates: DataFrame) -> DataStreamWriter:
        changes = live.snapshot_stream(updates, seed, by_event_time=True)
        return changes.writeStream.outputMode("update").format("noop")

    batches, _ = play(spark, folder, {"updates": rows}, writer, inputs.SEED_SLICES, ZONE_PARTITIONS)
    after = [
        (seed if batch is None else live.snapshot_table(spark, f"{folder}/checkpoint", batch)).select(
            F.lit(number).alias("slice"), "*"
        )
        for number, batch in enumerate(batches)
    ]
    return reduce(DataFrame.unionByName, after)


def fleet_after_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last statistics of a stream that takes back and adds what every change of a zone means."""
    folder = shared_dir(spark, "fleet")
    rows = _sliced_updates(spark, sf_dir).withColumn("seq", F.col("slice").cast("bigint"))
    kinds = []

    def writer(updates: DataFrame) -> DataStreamWriter:
        metrics = live.fleet_stream(updates)
        kinds.append(metrics.schema)
        return metrics.writeStream.outputMode("append").foreachBatch(
            lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/metrics/batch_id={number}")
        )

    play(spark, folder, {"updates": rows}, writer, inputs.LIVE_SLICES, ZONE_PARTITIONS)
    stored = spark.read.schema(T.StructType([*kinds[-1], T.StructField("batch_id", T.LongType())])).parquet(f"{folder}/metrics")
    last = stored.agg(F.max("batch_id").alias("batch_id"))
    return stored.join(F.broadcast(last), "batch_id").drop("batch_id")


def open_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that a stopped job has counted and not emitted yet, read from the state in its checkpoint."""
    folder = shared_dir(spark, "open")
    stream = job.price_stream(*inputs.event_streams(spark, sf_dir), PARAMS, job.FINAL)
    _run(spark, stream.updates.writeStream.outputMode(stream.output_mode).format("noop"), folder)
    return job.open_windows(spark, f"{folder}/checkpoint")


def _damaged(spark: SparkSession, sf_dir: str, folder: str) -> list[Files]:
    """Files of payloads in all conditions, of both kinds."""
    sources = [Files(f"{folder}/{kind}") for kind in (RIDE, HEARTBEAT)]
    for source, payloads in zip(sources, inputs.damaged_payloads(spark, sf_dir), strict=True):
        payloads.select("value").write.mode("overwrite").text(source.path)
    return sources


def refused_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads received and refused by the pricing job, added up over its micro-batches."""
    folder = shared_dir(spark, "refused")
    raw = [raw_stream(spark, source).select("value") for source in _damaged(spark, sf_dir, folder)]
    stream = job.price_stream_of_json(*raw, PARAMS)
    sink = publish(stream.updates, Files(f"{folder}/price-updates"), stream.output_mode)
    with Losses(spark) as losses:
        query = job.start(spark, sink, f"{folder}/checkpoint")
        query.awaitTermination()
        totals = losses.of(query)
    counts = [(name, totals[name]["received"], totals[name]["refused"]) for name in (job.RIDES_METRIC, job.HEARTBEATS_METRIC)]
    return spark.createDataFrame(counts, "stream STRING, received BIGINT, refused BIGINT")


def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that the exact mode drops over slices of the events, of which some come three slices late."""
    with Losses(spark) as losses:
        _, query = _fired(spark, sf_dir, job.EXACT, job.UNION, 0)
        late = losses.of(query)[LATE_METRIC]["events"]
    return spark.createDataFrame([(late,)], "late BIGINT")


def _ingested(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Damaged payloads of both kinds, each parsed once, stored as events and as refused."""
    folder = shared_dir(spark, name)
    for kind, source in zip((RIDE, HEARTBEAT), _damaged(spark, sf_dir, folder), strict=True):
        _run(spark, job.ingest(raw_stream(spark, source), kind, f"{folder}/ingested"), f"{folder}/{kind}-job")
    return folder


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused payloads of both raw streams, stored with their reason, counted by kind and reason."""
    folder = _ingested(spark, sf_dir, "quarantine")
    rows = [job.refused_of(spark, f"{folder}/ingested", kind) for kind in (RIDE, HEARTBEAT)]
    stored = rows[0].unionByName(rows[1])
    return stored.groupBy("kind", "reason").agg(F.count("value").alias("payloads"))


def ingested_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of the events that the same run stored beside the refused payloads."""
    folder = _ingested(spark, sf_dir, "ingested")
    events = [job.events_of(spark, f"{folder}/ingested", kind) for kind in (RIDE, HEARTBEAT)]
    stream = job.price_stream(*events, PARAMS)
    sink = Files(f"{folder}/price-updates")
    _run(spark, publish(stream.updates, sink, stream.output_mode), folder)
    return _last_updates(spark, sink)


def streamed_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote requests as a stream, joined with the snapshot and fare tables."""
    folder = shared_dir(spark, "quotes")
    history = to_table_types(price_updates(inputs.events(spark, sf_dir), inputs.WINDOW_MS))
    requests = inputs.quote_requests_of(inputs.table_stream(spark, sf_dir, "orders"))
    answered = quotes(
        requests,
        snapshot_of_history(history, inputs.AS_OF_MS),
        inputs.sample_fares(spark),
        inputs.AS_OF_MS,
        carry=("request_id",),
    )
    path = f"{folder}/quotes"
    _run(spark, answered.writeStream.format("parquet").option("path", path), folder)
    return spark.read.schema(answered.schema).parquet(path)
