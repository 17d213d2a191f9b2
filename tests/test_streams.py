from __future__ import annotations

import json
import os
import random
import subprocess
import sys
import time
from types import SimpleNamespace

import pytest
from conftest import ROOT
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ridetide.operators.history import history_range
from ridetide.operators.normalize import RIDE, normalize, to_table_types
from ridetide.operators.windows import price_updates
from ridetide.params import PricingParams
from ridetide.plans import inputs
from ridetide.schemas import PRICE_UPDATE
from ridetide.session import CHECKPOINT_DIR, STREAM_CONF, new_run, session_conf, shared_dir
from ridetide.sources.streams import PRICE_UPDATES, Broker, Files, debug_lines, debug_print, publish, raw_batch, raw_stream
from ridetide.streaming import exact, job
from ridetide.streaming.consumer import consume, log_rows, store_updates
from ridetide.streaming.store import UpdateLog

BASE = 1_000_000
PARAMS = PricingParams()


class Feed:
    """Two folders of JSON files; each ``send`` is one micro-batch."""

    def __init__(self, spark, root):
        self.spark, self.root, self.sent = spark, str(root), 0
        for name in ("rides", "beats"):
            os.makedirs(f"{self.root}/{name}")

    def send(self, rides=(), beats=()):
        self.sent += 1
        lines = {
            "rides": [{"zone_id": 1, "ts_event": BASE + t} for t in rides],
            "beats": [{"zone_id": 1, "ts_event": BASE + t, "status": s} for t, s in beats],
        }
        for name, rows in lines.items():
            if rows:
                hidden = f"{self.root}/{name}/.{self.sent}"
                with open(hidden, "w") as out:
                    out.writelines(json.dumps(row) + "\n" for row in rows)
                os.rename(hidden, f"{self.root}/{name}/{self.sent:03}.json")

    def batch(self, name):
        return raw_batch(self.spark, Files(f"{self.root}/{name}"))

    def stream(self, mode, idle_policy=job.STRICT):
        raw = [raw_stream(self.spark, Files(f"{self.root}/{name}")) for name in ("rides", "beats")]
        return job.price_stream_of_json(*raw, PARAMS, mode, idle_policy)


class Collected:
    """Rows of each micro-batch, as (window offset, demand, supply)."""

    def __init__(self):
        self.rows = []

    def __call__(self, batch, batch_id):
        self.rows += [(r.window_start - BASE, r.demand, r.supply) for r in batch.collect()]

    def take(self):
        taken, self.rows = sorted(self.rows), []
        return taken


def started(spark, stream, checkpoint, sink):
    writer = stream.updates.writeStream.outputMode(stream.output_mode).foreachBatch(sink)
    return job.start(spark, writer, str(checkpoint), interval="0 seconds")


def play(feed, query, sink, steps):
    got = []
    for rides, beats in steps:
        feed.send(rides, beats)
        query.processAllAvailable()
        got.append(sink.take())
    query.stop()
    return got


def test_exact_firing_sequence(spark, tmp_path):
    feed, sink = Feed(spark, tmp_path / "in"), Collected()
    query = started(spark, feed.stream(job.EXACT, job.UNION), tmp_path / "ck", sink)
    offsets = [[1000, 2000], [15000], [4000, 4100], [24000], [4200], [26000], [4300], [40000]]
    got = play(feed, query, sink, [(o, ()) for o in offsets])
    assert got == [
        [],
        [(0, 2, 0)],
        [(0, 4, 0)],
        [],
        [(0, 5, 0)],
        [],
        [],
        [(15000, 1, 0), (20000, 1, 0), (25000, 1, 0)],
    ]


def test_exact_late_first_event_fires_at_once(spark, tmp_path):
    feed, sink = Feed(spark, tmp_path / "in"), Collected()
    query = started(spark, feed.stream(job.EXACT, job.UNION), tmp_path / "ck", sink)
    got = play(feed, query, sink, [([16000], ()), ([1000], [(1500, "AVAILABLE")]), ([2000], [(2000, "BUSY")])])
    assert got == [[], [(0, 1, 1)], [(0, 2, 1)]]


def expected_firings(batches, size=5000, delay=10000, lateness=10000):
    """Plain model of the firing rule. batches: lists of (zone, ts, demand, supply)."""
    counts, fired, watermark, newest, out = {}, set(), 0, 0, []
    for batch in batches:
        emitted, touched = [], set()
        for zone, ts, demand, supply in batch:
            newest = max(newest, ts)
            key = (zone, ts // size * size)
            if key[1] + size + lateness > watermark:
                held = counts.setdefault(key, [0, 0])
                held[0] += demand
                held[1] += supply
                touched.add(key)
        for key in touched:
            if key[1] + size <= watermark:
                emitted.append((*key, *counts[key]))
                fired.add(key)
        watermark = max(watermark, newest - delay)
        for key, held in counts.items():
            if key not in fired and key[1] + size <= watermark:
                emitted.append((*key, *held))
                fired.add(key)
        out.append(sorted(emitted))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_mode_against_a_plain_model(spark, tmp_path, seed):
    rng = random.Random(seed)
    batches = []
    for step in range(7):
        ahead = BASE + step * 6_000
        batches.append(
            [
                (rng.randint(1, 3), ahead + rng.choice([0, 0, 0, -9_000, -16_000, -24_000]) + rng.randint(0, 4_999), *rng.choice([(1, 0), (0, 1), (0, 0)]))
                for _ in range(12)
            ]
        )
    got = []

    def sink(batch, batch_id):
        got[-1] += [(r.zone_id, r.window_start, r.demand, r.supply) for r in batch.collect()]

    for name in ("rides", "beats"):
        os.makedirs(tmp_path / name)
    raw = [raw_stream(spark, Files(str(tmp_path / name))) for name in ("rides", "beats")]
    stream = job.price_stream_of_json(*raw, PARAMS, job.EXACT, job.UNION)
    query = started(spark, stream, tmp_path / "ck", sink)
    for number, batch in enumerate(batches):
        # Rides, then heartbeats: each file is one micro-batch, and one batch of the model.
        for name, rows in (
            ("rides", [{"zone_id": z, "ts_event": t} for z, t, d, _ in batch if d]),
            ("beats", [{"zone_id": z, "ts_event": t, "status": "AVAILABLE" if s else "BUSY"} for z, t, d, s in batch if not d]),
        ):
            if rows:
                got.append([])
                hidden = tmp_path / name / f".{number}"
                hidden.write_text("".join(json.dumps(r) + "\n" for r in rows))
                hidden.rename(tmp_path / name / f"{number:03}.json")
                query.processAllAvailable()
    query.stop()
    steps = [
        part
        for batch in batches
        for part in ([e for e in batch if e[2]], [e for e in batch if not e[2]])
        if part
    ]
    assert [sorted(rows) for rows in got] == expected_firings(steps)


TWO_STREAMS = [
    ([1000, 2000], [(1500, "AVAILABLE"), (3000, "BUSY")]),
    ([15000], [(15000, "AVAILABLE")]),
    ([4000], ()),
    ([25000], [(25000, "AVAILABLE")]),
    ([4500], ()),
    ([26000], [(26000, "AVAILABLE")]),
]


def test_final_mode_emits_each_window_once_after_its_lateness(spark, tmp_path):
    feed, sink = Feed(spark, tmp_path / "in"), Collected()
    got = play(feed, started(spark, feed.stream(job.FINAL), tmp_path / "ck", sink), sink, TWO_STREAMS)
    assert got == [[], [], [], [(0, 3, 1)], [], []]


def test_live_mode_updates_until_the_lateness_is_over(spark, tmp_path):
    feed, sink = Feed(spark, tmp_path / "in"), Collected()
    got = play(feed, started(spark, feed.stream(job.LIVE), tmp_path / "ck", sink), sink, TWO_STREAMS)
    assert got == [
        [(0, 2, 1)],
        [(15000, 1, 1)],
        [(0, 3, 1)],
        [(25000, 1, 1)],
        [],
        [(25000, 2, 2)],
    ]


@pytest.mark.parametrize(("policy", "emitted"), [(job.STRICT, []), (job.UNION, [(0, 1, 0)])])
def test_a_silent_stream(spark, tmp_path, policy, emitted):
    feed, sink = Feed(spark, tmp_path / "in"), Collected()
    query = started(spark, feed.stream(job.FINAL, policy), tmp_path / "ck", sink)
    got = play(feed, query, sink, [([1000], ()), ([60000], ())])
    assert got == [[], emitted]


def test_ticks_let_a_silent_stream_hold_nothing_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(job, "IDLE_MS", 1_000)
    params = PricingParams(window_ms=1_000, out_of_orderness_ms=500, lateness_ms=500)
    for name in ("rides", "beats"):
        os.makedirs(tmp_path / name)
    now = int(time.time() * 1000)
    (tmp_path / "rides" / "1.json").write_text(json.dumps({"zone_id": 1, "ts_event": now}) + "\n")
    raw = [raw_stream(spark, Files(str(tmp_path / name))) for name in ("rides", "beats")]
    stream = job.price_stream_of_json(*raw, params, job.FINAL, job.TICKS)
    got = []

    def sink(batch, batch_id):
        got.extend((r.window_start, r.demand, r.supply) for r in batch.collect())

    query = started(spark, stream, tmp_path / "ck", sink)
    until = time.time() + 60
    while not got and time.time() < until:
        time.sleep(0.5)
    query.stop()
    assert got == [(now - now % 1000, 1, 0)]


def test_a_failing_job_is_started_again(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    feed.send([1000], ())
    stream, failures, rows = feed.stream(job.LIVE), [], []

    def sink(batch, batch_id):
        if len(failures) < 2:
            failures.append(batch_id)
            raise RuntimeError("sink is down")
        rows.extend(batch.collect())

    writer = stream.updates.writeStream.outputMode(stream.output_mode).foreachBatch(sink)
    job.supervise(spark, writer, str(tmp_path / "ck"), restarts=2, pause_s=0.1)
    assert failures == [0, 0] and len(rows) == 1
    failures.clear()
    feed.send([2000], ())
    with pytest.raises(Exception, match="sink is down"):
        job.supervise(spark, writer, str(tmp_path / "ck"), restarts=1, pause_s=0.1)


def test_refused_payloads_are_kept_with_their_kind(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.send([1000], [(1000, "BUSY")])
    (tmp_path / "rides" / "bad.json").write_text('{"zone_id":1}\n')
    rows = job.refused_payloads(feed.batch("rides"), feed.batch("beats")).collect()
    assert [(r.kind, r.reason) for r in rows] == [("RIDE", "missing ts_event")]


def in_order_batches(spark, sf_dir, feed_root, parts=3):
    """The events as ``parts`` time-ordered files per stream."""
    rides, beats = inputs.payloads(spark, sf_dir)
    for name, raw in (("rides", rides), ("beats", beats)):
        rows = raw.withColumn("ts", F.get_json_object("value", "$.ts_event").cast("bigint")).orderBy("ts").collect()
        step = -(-len(rows) // parts)
        for part in range(parts):
            yield name, part, [r.value for r in rows[part * step : (part + 1) * step]]


def test_restart_replay_and_batch_equivalence(spark, sf_dir, tmp_path):
    """Stop between micro-batches, restart from the checkpoint, store one batch twice: the tables
    equal those of a batch run."""
    params = PricingParams(window_ms=inputs.WINDOW_MS)
    log = UpdateLog(spark, str(tmp_path / "updates"))
    for name in ("rides", "beats"):
        os.makedirs(tmp_path / name)
    files = list(in_order_batches(spark, sf_dir, tmp_path))
    batch_ids, middle = [], []
    for part in range(3):
        for name, number, lines in files:
            if number == part:
                (tmp_path / name / f"{number}.json").write_text("\n".join(lines) + "\n")
        raw = [raw_stream(spark, Files(str(tmp_path / name))) for name in ("rides", "beats")]
        stream = job.price_stream_of_json(*raw, params)
        writer = store_updates(stream.updates, log, stream.output_mode, 0, run=1)
        query = job.start(spark, writer, str(tmp_path / "ck"))
        query.awaitTermination()
        batch_ids.append(query.lastProgress["batchId"])
        middle.append(sorted(log.history().collect()))
    assert batch_ids == sorted(batch_ids) and batch_ids[0] < batch_ids[-1]

    stored = sorted(log.history().collect())
    assert middle[-1] == stored != middle[0]

    events = inputs.events(spark, sf_dir)
    assert stored == sorted(to_table_types(price_updates(events, inputs.WINDOW_MS)).collect())

    assert log.rows().count() >= len(stored)
    table = log.rewrite(str(tmp_path / "table"))
    assert sorted(table.drop("day").collect()) == stored


def test_rewritten_history_is_pruned_by_the_range(spark, tmp_path):
    log = UpdateLog(spark, str(tmp_path / "updates"))
    log.append(wire_rows(spark, [(1, w, 1) for w in range(10)]), 0, 1)
    table = log.rewrite(str(tmp_path / "table"))
    day = F.col("day") == F.lit("1970-01-01").cast("date")
    found = history_range(table.where(day).drop("day"), 10_000, 20_000, 1)
    assert [r.window_start.second for r in found.collect()] == [15, 10]
    explain = spark._jvm.PythonSQLUtils.explainString
    scans = explain(found._jdf.queryExecution(), "formatted").splitlines()
    assert any("PartitionFilters" in line and "day" in line for line in scans)
    pushed = [line for line in scans if "PushedFilters" in line]
    assert pushed
    for scan in pushed:
        for wanted in ("EqualTo(zone_id,1)", "GreaterThanOrEqual(window_start,", "LessThan(window_start,"):
            assert wanted in scan


def wire_rows(spark, rows, as_of_ms=0):
    """rows: (zone, window number, demand)"""
    wire = spark.createDataFrame([json.loads(update_line(z, w * 5000, d)) for z, w, d in rows], PRICE_UPDATE)
    return log_rows(wire.withColumn("seq", F.lit(0).cast("bigint")), as_of_ms)


def contents(log):
    stored = {(r.zone_id, r.window_start.second // 5): r.demand for r in log.history().collect()}
    current = {r.zone_id: r.demand for r in log.snapshot().collect()}
    newest = {r.zone_id: r.demand for r in log.snapshot(True).collect()}
    return stored, current, newest


def test_a_later_run_counts_as_later(spark, tmp_path):
    """Micro-batches are numbered from 0 again: nothing is overwritten, hidden or ordered wrongly."""
    log = UpdateLog(spark, str(tmp_path / "log"))
    log.append(wire_rows(spark, [(1, 0, 1), (2, 0, 1)]), 0, 1_999)
    log.append(wire_rows(spark, [(1, 1, 13)]), 1, 1_999)
    log.append(wire_rows(spark, [(1, 0, 99)]), 0, 9_999_999_999)
    wanted = ({(1, 0): 99, (1, 1): 13, (2, 0): 1}, {1: 99, 2: 1}, {1: 13, 2: 1})
    assert contents(log) == wanted
    log.append(wire_rows(spark, [(2, 1, 7)]), 1, 9_999_999_999)
    wanted[0][(2, 1)], wanted[1][2], wanted[2][2] = 7, 7, 7
    assert contents(log) == wanted
    log.append(wire_rows(spark, [(1, 0, 5)]), 1, 9_999_999_999)  # a repeated micro-batch
    assert contents(log) == wanted


def test_runs_are_never_equal():
    runs = [new_run() for _ in range(100)]
    assert runs == sorted(set(runs)) and abs(runs[0] - time.time()) < 200


def test_views_are_hash_aggregates(spark, tmp_path):
    log = UpdateLog(spark, str(tmp_path / "log"))
    log.append(wire_rows(spark, [(1, w, w) for w in range(5)]), 0, 1)
    for view in (log.history(), log.snapshot(), log.snapshot(True)):
        plan = view._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "Window" not in plan


@pytest.mark.parametrize("run", [None, 4])
def test_a_new_checkpoint_loses_nothing(spark, tmp_path, run):
    """Two checkpoints on the same folders, with the default run and with the same run given twice."""
    sink, log = Files(str(tmp_path / "out")), UpdateLog(spark, str(tmp_path / "log"))
    for part, zone_ms in enumerate((1000, 900_000)):
        feed = Feed(spark, tmp_path / f"in-{part}")
        feed.send([zone_ms], [(zone_ms, "AVAILABLE")])
        stream = feed.stream(job.LIVE)
        for name, writer in (
            ("publish", publish(stream.updates, sink, stream.output_mode, run)),
            ("store", store_updates(stream.updates, log, stream.output_mode, 0, run)),
        ):
            job.start(spark, writer, str(tmp_path / f"{name}-{part}")).awaitTermination()
    starts = {json.loads(row.value)["window_start"] for row in raw_batch(spark, sink).collect()}
    assert starts == {BASE, BASE + 900_000} and log.history().count() == 2
    assert {row.run for row in log.rows().collect()} == {4} if run else log.rows().select("run").distinct().count() == 2


def update_line(zone, start, demand):
    names = "zone_id window_start window_end demand supply ratio surge_multiplier ts_compute".split()
    return json.dumps(dict(zip(names, (zone, start, start + 5000, demand, 1, float(demand), 1.5, start + 5000))))


def test_table_job_stores_feeds_and_fails_fast(spark, tmp_path):
    published, log = tmp_path / "price-updates", UpdateLog(spark, str(tmp_path / "log"))
    subscribed = spark.createDataFrame([(1,), (99,)], "zone_id INT")

    def run():
        raw = raw_stream(spark, Files(str(published)))
        writer = consume(raw, log, 0, str(tmp_path / "feeds"), subscribed)
        job.start(spark, writer, str(tmp_path / "ck")).awaitTermination()

    def publish_lines(batch, lines):
        folder = published / f"batch_id={batch}"
        folder.mkdir(parents=True)
        (folder / "part.txt").write_text("\n".join(lines) + "\n")

    # One micro-batch reads both publications; the later one holds the current counts.
    publish_lines(0, [update_line(1, 0, 1), update_line(2, 0, 1)])
    publish_lines(1, [update_line(1, 0, 3)])
    run()
    assert sorted((r.zone_id, r.demand) for r in log.history().collect()) == [(1, 3), (2, 1)]
    assert spark.read.text(str(tmp_path / "feeds" / "all")).count() == 3
    zone = spark.read.text(str(tmp_path / "feeds" / "zones")).select("zone_id").collect()
    assert [r.zone_id for r in zone] == [1, 1]

    publish_lines(2, [update_line(1, 5000, 4), '{"zone_id":1}'])
    with pytest.raises(Exception, match="unusable price update"):
        run()
    assert sorted((r.zone_id, r.demand) for r in log.history().collect()) == [(1, 3), (2, 1)]
    (published / "batch_id=2" / "part.txt").write_text(update_line(1, 5000, 4) + "\n")
    (published / "batch_id=2" / ".part.txt.crc").unlink(missing_ok=True)
    run()
    assert {(r.zone_id, r.demand) for r in log.snapshot().collect()} == {(1, 4), (2, 1)}


def test_broker_options():
    source = Broker("b1:9092,b2:9092", PRICE_UPDATES, {"kafka.security.protocol": "SSL"})
    assert source.read_options() == {
        "kafka.bootstrap.servers": "b1:9092,b2:9092",
        "subscribe": "price-updates",
        "startingOffsets": "latest",
        "kafka.security.protocol": "SSL",
    }
    assert source.write_options()["topic"] == "price-updates"


PRINTING = """
import sys
sys.path.insert(0, sys.argv[1])
from ridetide.plans import inputs
from ridetide.session import local_session
from ridetide.sources.streams import Files, debug_print, raw_stream
from ridetide.streaming import job
spark = local_session("2", 2)
raw = [raw_stream(spark, Files(f"{sys.argv[2]}/{name}")) for name in ("rides", "beats")]
stream = job.price_stream_of_json(*raw)
job.start(spark, debug_print(stream.updates, stream.output_mode), f"{sys.argv[2]}/ck").awaitTermination()
"""


def test_debug_print_prints_every_update(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.send([w * 5000 for w in range(30)], [(1000, "BUSY")])
    command = [sys.executable, "-c", PRINTING, str(ROOT), str(tmp_path)]
    said = subprocess.run(command, capture_output=True, text=True, check=True, timeout=180)
    lines = [line for line in (said.stdout + said.stderr).splitlines() if "PRICE-UPDATE> {" in line]
    assert len(lines) == len(set(lines)) == 30 and all(line.startswith("PRICE-UPDATE> {") and line.endswith("}") for line in lines)
    printed = debug_lines(price_updates(normalize(feed.batch("rides"), RIDE), 5000)).collect()
    assert min(r.value for r in printed).startswith('PRICE-UPDATE> {"zone_id":1,"window_start":1000000,')


def test_shared_dir_comes_from_the_session():
    def session(master, settings):
        context = SimpleNamespace(master=master, getConf=lambda: {})
        return SimpleNamespace(conf=settings, sparkContext=context)

    named = session("spark://host", {CHECKPOINT_DIR: "hdfs:///shared/"})
    assert shared_dir(named, "x").startswith("hdfs:///shared/ridetide/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host", {}), "x")


def test_session_settings_are_put_back(spark):
    key = next(iter(STREAM_CONF))
    before = spark.conf.get(key, None)
    with session_conf(spark, STREAM_CONF):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key, None) == before


def test_worker_code_needs_no_installed_package(tmp_path):
    """Executors need not have this package: the exact mode travels by value."""
    shipped = tmp_path / "shipped"
    shipped.write_bytes(cloudpickle.dumps((exact._add_up, exact._WindowFiring(5, 5))))
    script = (
        "import sys, pyarrow as pa\n"
        "from pyspark import cloudpickle\n"
        f"add_up, _ = cloudpickle.loads(open({str(shipped)!r}, 'rb').read())\n"
        "rows = pa.record_batch({'zone_id': [1, 1], 'window_start': [0, 0], 'demand': [1, 2], 'supply': [0, 1], 'events': [1, 4]})\n"
        "(summed,) = add_up(iter([rows, rows]))\n"
        "assert 'ridetide' not in sys.modules and summed.to_pylist() == [\n"
        "    {'zone_id': 1, 'window_start': 0, 'demand': 6, 'supply': 2, 'events': 10}]\n"
    )
    env = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, check=True, timeout=60)


def test_unknown_modes(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    with pytest.raises(ValueError, match="unknown mode"):
        feed.stream("fast")
    with pytest.raises(ValueError, match="unknown idle policy"):
        feed.stream(job.LIVE, "never")


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        PricingParams(window_ms=0)
    with pytest.raises(ValueError):
        PricingParams(lateness_ms=-1)
