"""What the jobs leave out: counted over all micro-batches, and stored by the same parse."""

from __future__ import annotations

import json

import pytest

from ridetide.operators.normalize import HEARTBEAT, RIDE, judge, normalize, quarantine
from ridetide.params import PricingParams
from ridetide.sources.streams import Files, raw_stream
from ridetide.streaming import job
from ridetide.streaming.losses import LATE_METRIC, Losses

FILES = 150


def test_counts_are_exact_over_more_micro_batches_than_spark_remembers(spark, tmp_path):
    """Every file is a micro-batch; the query stops once in between."""
    (tmp_path / "rides").mkdir()
    whole, broken = json.dumps({"zone_id": 1, "ts_event": 5}), '{"zone_id":1}'

    def add(numbers):
        for number in numbers:
            (tmp_path / "rides" / f"{number:04}.json").write_text(f"{whole}\n" * (number % 5) + f"{broken}\n" * (number % 3 + 1))

    def run():
        raw = raw_stream(spark, Files(str(tmp_path / "rides"), {"maxFilesPerTrigger": "1"}))
        writer = normalize(raw, RIDE, counted=job.RIDES_METRIC).writeStream.format("noop")
        query = job.start(spark, writer, str(tmp_path / "ck"))
        query.awaitTermination()
        return query

    refused = sum(number % 3 + 1 for number in range(FILES))
    with Losses(spark) as losses:
        add(range(130))
        assert len(run().recentProgress) < 130
        add(range(130, FILES))
        assert losses.of(run())[job.RIDES_METRIC] == {"received": refused + sum(n % 5 for n in range(FILES)), "refused": refused}


def test_a_repeated_micro_batch_counts_once(spark):
    losses, query = Losses(spark), "q"
    told = lambda n: {"rides": {"received": n, "refused": 1}}
    nothing = {"watermark": {"rows": 0}}
    for batch, what in ((0, told(5)), (1, told(7)), (1, told(8)), (1, nothing), (2, told(1)), (0, told(99))):
        losses._put(query, batch, what)
    totals = {key: losses._sums[query]["rides"][key] + losses._last[query][1]["rides"][key] for key in ("received", "refused")}
    assert totals == {"received": 14, "refused": 3}


@pytest.mark.parametrize("mode", [job.EXACT, job.LIVE])
def test_events_that_come_too_late_are_counted(spark, tmp_path, mode):
    base, params = 1_000_000, PricingParams(window_ms=5000, out_of_orderness_ms=10_000, lateness_ms=10_000)
    for name in ("rides", "beats"):
        (tmp_path / name).mkdir()
    with Losses(spark) as losses:
        for number, offsets in enumerate([[1000], [60_000], [2000, 2100, 61_000], [3000]]):
            lines = [json.dumps({"zone_id": 1, "ts_event": base + offset}) for offset in offsets]
            (tmp_path / "rides" / f"{number}.json").write_text("\n".join(lines) + "\n")
            raw = [raw_stream(spark, Files(str(tmp_path / name))) for name in ("rides", "beats")]
            stream = job.price_stream_of_json(*raw, params, mode, job.UNION)
            writer = stream.updates.writeStream.outputMode(stream.output_mode).format("noop")
            query = job.start(spark, writer, str(tmp_path / "ck"), settings={"spark.sql.shuffle.partitions": "2"})
            query.awaitTermination()
        totals = losses.of(query)
    if mode == job.EXACT:
        assert totals[LATE_METRIC] == {"events": 3}
    else:
        # A row per task, zone and window: of the two events in one file, one.
        assert totals["watermark"] == {"rows": 2}
    assert totals[job.RIDES_METRIC] == {"received": 6, "refused": 0}


TEXTS = [
    json.dumps({"zone_id": 3, "ts_event": 5, "status": "BUSY"}),
    '{"zone_id":"x","ts_event":5,"status":"AVAILABLE"}',
    '{"ts_event":5,"status":"BUSY"}',
    '{"zone_id":3,"status":"BUSY"}',
    '{"zone_id":3,"ts_event":5}',
    '{"zone_id":3,"ts_event":9223372036854775807,"status":"BUSY"}',
    "{broken",
    "",
    None,
    "[1]",
]


@pytest.mark.parametrize("kind", [RIDE, HEARTBEAT])
def test_one_parse_gives_both_outcomes(spark, kind):
    raw = spark.createDataFrame([(text,) for text in TEXTS], "value string")
    judged = judge(raw, kind)
    events = judged.where("outcome = 'event'").select("kind", "zone_id", "ts_event", "status")
    refused = judged.where("outcome = 'refused'").select("value", "reason")
    assert sorted(events.collect(), key=repr) == sorted(normalize(raw, kind).collect(), key=repr)
    assert sorted(refused.collect(), key=repr) == sorted(quarantine(raw, kind).collect(), key=repr)
    assert judged.count() == len(TEXTS)


def test_a_payload_is_parsed_once(spark, tmp_path):
    raw = spark.createDataFrame([(text,) for text in TEXTS], "value string")
    raw.write.parquet(f"{tmp_path}/in")
    judged = judge(spark.read.parquet(f"{tmp_path}/in"), RIDE)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") + plan.count("JsonToStructs") + plan.count("parse_json") == 1


def test_ingested_payloads_are_stored_once_each(spark, tmp_path):
    """Two runs from one checkpoint: events on as a stream, refused payloads as a table."""
    (tmp_path / "in").mkdir()
    for part in range(2):
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(text for text in TEXTS if text) + "\n")
        writer = job.ingest(raw_stream(spark, Files(str(tmp_path / "in"))), HEARTBEAT, str(tmp_path / "out"))
        job.start(spark, writer, str(tmp_path / "ck")).awaitTermination()
    refused = job.refused_of(spark, str(tmp_path / "out"), HEARTBEAT)
    reasons = {row["reason"]: row["count"] for row in refused.groupBy("reason").count().collect()}
    assert reasons == {"unparsable": 4, "missing zone_id": 2, "missing ts_event": 2, "missing status": 2, "ts_event out of range": 2}
    events = job.events_of(spark, str(tmp_path / "out"), HEARTBEAT)
    assert events.isStreaming
    rows = []
    writer = events.writeStream.foreachBatch(lambda batch, _: rows.extend(batch.collect()))
    job.start(spark, writer, str(tmp_path / "on")).awaitTermination()
    assert sorted((row["zone_id"], row["status"]) for row in rows) == [(0, "AVAILABLE")] * 2 + [(3, "BUSY")] * 2
