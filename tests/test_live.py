"""Live tables as state: seed rows, quotes, recent windows, statistics, and what a stopped job holds."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from ridetide.operators.latest import snapshot_of_history
from ridetide.operators.normalize import to_table_types
from ridetide.operators.stats import fleet_metrics
from ridetide.plans import inputs, streams
from ridetide.schemas import PRICE_UPDATE
from ridetide.sources.seeds import seed_snapshot
from ridetide.streaming import job, live

FEW = {"spark.sql.shuffle.partitions": "2"}


def updates_of(spark, rows):
    """rows: (zone, window number, demand, surge in hundredths, seq)"""
    frame = spark.createDataFrame(rows, "zone_id int, n long, demand long, cents long, seq long")
    return frame.select(
        "zone_id",
        (F.col("n") * 5000).alias("window_start"),
        (F.col("n") * 5000 + 5000).alias("window_end"),
        "demand",
        F.lit(2).cast("bigint").alias("supply"),
        (F.col("demand") / 2).alias("ratio"),
        (F.col("cents") / 100).alias("surge_multiplier"),
        (F.col("n") * 5000 + 5000).alias("ts_compute"),
        "seq",
    )


class Stream:
    """A folder of updates; each ``send`` is one micro-batch of a query that goes on from its checkpoint."""

    def __init__(self, spark, root, step, output_mode, settings=FEW):
        self.spark, self.root, self.step, self.mode, self.settings = spark, str(root), step, output_mode, settings

    def send(self, rows):
        updates_of(self.spark, rows).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        stream = self.spark.readStream.schema(f"{PRICE_UPDATE}, seq BIGINT").parquet(f"{self.root}/in")
        out = []
        writer = self.step(stream).writeStream.outputMode(self.mode).foreachBatch(lambda batch, _: out.extend(batch.collect()))
        job.start(self.spark, writer, f"{self.root}/ck", settings=self.settings).awaitTermination()
        return out


def test_seed_rows_are_the_first_state(spark, tmp_path):
    seed = seed_snapshot(spark, 1000)

    def step(updates):
        return live.snapshot_stream(updates.withColumn("updated_at", F.col("ts_compute")), seed)

    stream = Stream(spark, tmp_path, step, "update")
    (changed,) = stream.send([(1, 3, 7, 150, 1), (1, 2, 6, 140, 1)])
    assert (changed.zone_id, changed.window_start) == (1, 15000)
    # A late window arrives last, and wins; zone 2 has no seed row.
    stream.send([(1, 1, 5, 130, 2), (2, 9, 1, 100, 2)])
    rows = {row.zone_id: row for row in live.snapshot_table(spark, f"{tmp_path}/ck").collect()}
    before = {row.zone_id: row for row in live.snapshot_table(spark, f"{tmp_path}/ck", batch_id=0).collect()}
    seeds = {row.zone_id: row for row in seed.collect()}
    assert set(rows) == set(seeds) | {2} and set(before) == set(seeds)
    assert all(rows[zone] == seeds[zone] for zone in seeds if zone != 1)
    assert (rows[1].demand, before[1].demand, rows[2].demand) == (5, 7, 1)


def test_recent_windows_are_bounded_and_replaced_in_place(spark, tmp_path):
    stream = Stream(spark, tmp_path, lambda updates: live.recent_stream(updates, most=3), "update")

    def held():
        return {(row.zone_id, row.window_start // 5000): row.demand for row in live.recent_table(spark, f"{tmp_path}/ck").collect()}

    stream.send([(1, n, n, 100, 1) for n in range(5)] + [(2, 0, 9, 100, 1)])
    assert held() == {(1, 2): 2, (1, 3): 3, (1, 4): 4, (2, 0): 9}
    # Window 3 fires again, an older version of window 4 comes late, window 1 is gone for good.
    out = stream.send([(1, 3, 33, 100, 2), (1, 4, 40, 100, 0), (1, 1, 11, 100, 2), (2, 0, 8, 100, 1), (2, 0, 10, 100, 2)])
    assert held() == {(1, 2): 2, (1, 3): 33, (1, 4): 4, (2, 0): 10}
    assert sorted((row.zone_id, row.demand) for row in out) == [(1, 33), (2, 10)]


@pytest.mark.parametrize(("order", "most"), [(("window_start", "seq"), 1), (("window_start", "seq"), 4), (("seq", "window_start"), 1)])
def test_a_task_passes_on_the_newest_rows_only(spark, order, most):
    """In several batches, with windows that fire again and a null zone: what is left out is never kept by a step."""
    pick = random.Random(8)
    rows = [(pick.choice([1, 2, 3, None]), pick.randrange(12), n, 100 + n, pick.randrange(40)) for n in range(300)]
    rows = list({(row[0], row[1], row[4]): row for row in rows}.values())
    updates = updates_of(spark, rows).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = live.newest_of_tasks(updates, order, most).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best: dict = {}
    for row in updates.collect():
        held = best.setdefault(row.zone_id, {})
        first, second = (row[name] for name in order)
        if first not in held or held[first][order[1]] < second:
            held[first] = row
    wanted = [held[first] for held in best.values() for first in sorted(held)[-most:]]
    assert sorted(map(str, got)) == sorted(map(str, wanted)) and len(got) < len(rows) / 4
    assert live.newest_of_tasks(updates.where(F.lit(False)), order, most).count() == 0


def test_of_one_window_the_last_arrival_is_current(spark, tmp_path):
    def step(updates):
        return live.snapshot_stream(updates.withColumn("updated_at", F.col("ts_compute")), seed_snapshot(spark, 1000), by_event_time=True)

    stream = Stream(spark, tmp_path, step, "update")
    (changed,) = stream.send([(1, 3, 7, 150, 1), (1, 3, 8, 160, 2), (1, 2, 6, 140, 3)])
    assert (changed.window_start, changed.demand) == (15000, 8)


def test_published_files_are_read_in_few_micro_batches(spark, sf_dir, tmp_path, monkeypatch):
    """Their number follows neither the files nor the partitions of the job that wrote them."""
    monkeypatch.setattr(streams, "shared_dir", lambda _, name: f"{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        streams.recent_windows(spark, sf_dir).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    commits = [name for name in os.listdir(f"{tmp_path}/recent/checkpoint/commits") if name.isdigit()]
    assert 2 <= len(commits) <= streams.RECENT_BATCHES
    state = [name for name in os.listdir(f"{tmp_path}/recent/checkpoint/state/0") if name.isdigit()]
    assert len(state) == streams.ZONE_PARTITIONS


def test_statistics_follow_every_change(spark, tmp_path):
    """After each micro-batch they equal those of a snapshot of all updates so far."""
    pick = random.Random(5)
    stream, sent = Stream(spark, tmp_path, live.fleet_stream, "append"), []
    for number in range(4):
        rows = [(pick.randint(1, 6), pick.randint(0, 9), pick.randint(0, 50), pick.choice([100, 120, 149, 150, 199, 250, 700]), number) for _ in range(7)]
        # One version of a window, as in a history.
        rows = list({row[:2]: row for row in rows if row[:2] not in {old[:2] for old in sent}}.values())
        sent += rows
        out = stream.send(rows)
        history = to_table_types(updates_of(spark, sent).drop("seq"))
        (wanted,) = fleet_metrics(snapshot_of_history(history, 0)).collect()
        if out:
            (got,) = out
            assert got == wanted
    assert len(sent) > 15


def test_a_request_gets_the_price_of_its_moment(spark, tmp_path):
    """Of earlier micro-batches any price, of its own only what was computed at its time or before."""
    names = "request_id long, origin_zone_id int, destination_zone_id int, estimated_distance_km double, estimated_duration_min double, ts long"
    quoted: list = []

    def play(requests, rows):
        asked = [(n, zone, 1, 1.0, 1.0, ts) for n, zone, ts in requests]
        spark.createDataFrame(asked, names).coalesce(1).write.mode("append").parquet(f"{tmp_path}/asked")
        updates_of(spark, rows).drop("seq").coalesce(1).write.mode("append").parquet(f"{tmp_path}/prices")
        streams = [spark.readStream.schema(kind).parquet(f"{tmp_path}/{name}") for name, kind in (("asked", names), ("prices", PRICE_UPDATE))]
        live_quotes = live.live_quotes(*streams, inputs.sample_fares(spark), copies=3)
        writer = live_quotes.writeStream.outputMode("update").foreachBatch(lambda batch, _: quoted.extend(batch.collect()))
        job.start(spark, writer, f"{tmp_path}/ck", settings=FEW).awaitTermination()
        got = {row.request_id: row.demand for row in quoted}
        quoted.clear()
        return got

    prices = [(1, 0, 11, 110, 0), (1, 1, 12, 120, 0), (2, 4, 13, 130, 0)]
    assert play([(1, 1, 4999), (2, 1, 5000), (3, 1, 9999), (4, 1, 99_999), (5, 2, 0), (6, 99, 0)], prices) == {1: 0, 2: 11, 3: 11, 4: 12, 5: 0}
    # All of the first micro-batch is known by now; a late price does not replace a newer one.
    assert play([(n, 1, 0) for n in range(10, 30)] + [(30, 2, 0), (31, 3, 0)], [(1, 0, 99, 190, 0)]) == {**dict.fromkeys(range(10, 30), 12), 30: 13, 31: 0}


@pytest.mark.parametrize("fails", [False, True])
def test_open_windows_of_a_stopped_or_failed_job(spark, sf_dir, tmp_path, fails):
    """The state in the checkpoint is what a batch run counts for the windows that are not closed."""
    events = inputs.events(spark, sf_dir)
    events.write.partitionBy("kind").parquet(f"{tmp_path}/in")
    schema = "zone_id int, ts_event long, status string"
    streams = [
        spark.readStream.schema(schema).parquet(f"{tmp_path}/in/kind={kind}").select(F.lit(kind).alias("kind"), "zone_id", "ts_event", "status")
        for kind in ("RIDE", "HEARTBEAT")
    ]
    from ridetide.operators.windows import price_updates
    from ridetide.params import PricingParams

    stream = job.price_stream(*streams, PricingParams(window_ms=inputs.WINDOW_MS), job.FINAL)

    def sink(batch, number):
        batch.count()
        if fails and number == 1:
            raise RuntimeError("lost")

    query = job.start(spark, stream.updates.writeStream.outputMode("append").foreachBatch(sink), f"{tmp_path}/ck")
    try:
        query.awaitTermination()
    except Exception:  # noqa: BLE001
        assert fails
    everything = price_updates(events, inputs.WINDOW_MS)
    ends = events.groupBy("kind").agg(F.max("ts_event").alias("ts")).agg(F.min("ts")).first()[0] - 20_000
    # Before the second micro-batch nothing has been closed.
    batch, wanted = (0, everything) if fails else (None, everything.where(F.col("window_end") > ends))
    got = job.open_windows(spark, f"{tmp_path}/ck", batch)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.select(*got.columns).collect()))
