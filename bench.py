"""Headline queries, warm, in seconds: prints one JSON line.

Each query runs to a sink that computes every row and keeps none. Batch queries are medians of
BENCH_RUNS runs, streams of three. Beside them: rows per second of the streams, state of the live
stream, seconds from a restart to the first committed micro-batch, and milliseconds from a new
file of events to its price. Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS, BENCH_QUERIES
(names, blank-separated).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from ridetide.params import PricingParams
from ridetide.plans import inputs
from ridetide.plans.catalog import QUERIES
from ridetide.session import local_session, shared_dir
from ridetide.streaming import job

STREAMS = (
    "stream_price_updates stream_final stream_exact stream_history stream_json_history stream_quotes "
    "stream_history_new_checkpoint"
).split()
STREAM_RUNS = 3
STREAM_ROWS = {"stream_quotes": "orders"}
LATENCY_FILES = 7


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    rows: DataFrame = QUERIES[name](spark, sf_dir)
    rows.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def state_and_restart(spark: SparkSession, sf_dir: str) -> dict:
    """The live stream over all events, then started again from its checkpoint until it is caught up."""
    folder = shared_dir(spark, "bench-restart")
    params = PricingParams(window_ms=inputs.WINDOW_MS)

    def run():
        stream = job.price_stream(*inputs.event_streams(spark, sf_dir), params)
        writer = stream.updates.writeStream.outputMode(stream.output_mode).format("noop")
        began = time.perf_counter()
        query = job.start(spark, writer, folder, "0 seconds")
        query.processAllAvailable()
        took = time.perf_counter() - began
        operators = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        query.stop()
        return took, operators

    _, operators = run()
    restart, _ = run()
    return {
        "state_rows": max(o["numRowsUpdated"] for o in operators),
        "state_mb": round(max(o["memoryUsedBytes"] for o in operators) / 1e6, 2),
        "restart_s": round(restart, 2),
    }


def latency_ms(spark: SparkSession) -> float:
    """Median time from a complete file of events to its price in a sink, without a trigger interval."""
    folder = shared_dir(spark, "bench-latency").removeprefix("file:")
    schema = "kind STRING, zone_id INT, ts_event BIGINT, status STRING"
    for name in ("rides", "beats"):
        os.makedirs(f"{folder}/{name}")
    sources = [spark.readStream.schema(schema).json(f"{folder}/{name}") for name in ("rides", "beats")]
    arrived: list[float] = []
    stream = job.price_stream(*sources)
    sink = stream.updates.writeStream.outputMode(stream.output_mode).foreachBatch(
        lambda batch, _: arrived.append(time.perf_counter()) if batch.count() else None
    )
    query = job.start(spark, sink, f"{folder}/checkpoint", "0 seconds")
    took = []
    for number in range(LATENCY_FILES):
        before = len(arrived)
        row = {"kind": "RIDE", "zone_id": 1, "ts_event": 1_000_000 + number, "status": None}
        with open(f"{folder}/rides/.{number}", "w") as out:
            out.write(json.dumps(row) + "\n")
        began = time.perf_counter()
        os.rename(f"{folder}/rides/.{number}", f"{folder}/rides/{number}.json")
        while len(arrived) == before and time.perf_counter() - began < 30:
            time.sleep(0.002)
        took.append((time.perf_counter() - began) * 1000)
    query.stop()
    return round(statistics.median(took[1:]), 1)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    batch = [name for name in QUERIES if not name.startswith("stream_")]
    wanted = os.environ.get("BENCH_QUERIES", "").split() or [*batch, *STREAMS]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")

    timings = {}
    for name in wanted:
        seconds(spark, name, sf_dir)
        times = STREAM_RUNS if name in STREAMS else runs
        timings[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(times)), 3)

    rates = {}
    for name in sorted(set(wanted) & set(STREAMS)):
        rows = inputs.table(spark, sf_dir, STREAM_ROWS.get(name, "events")).count()
        rates[name] = round(rows / timings[name])
    result = {
        "metric": "sum of median query seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "stream_rows_per_sec": rates,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if "BENCH_QUERIES" not in os.environ:
        result |= state_and_restart(spark, sf_dir) | {"event_to_price_ms": latency_ms(spark)}
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
