"""Raw JSON streams and their sinks, from a broker or from files.

Both kinds of source give ``value STRING`` and ``seq BIGINT``, where ``seq`` orders the records of
one zone: the broker offset (records are keyed by zone, so a zone stays in one partition), or the
run and micro-batch that wrote the file. Files in no such folder have ``seq`` 0. A run is a number of at
most ten digits, greater for a job that starts later.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import DataFrame, DataFrameWriter, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ridetide.functions.wire import price_update_json, zone_key
from ridetide.session import batch_folder, new_run, write_once

# What runs in Python workers, which need not have this package installed, travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Topics.
RIDE_REQUESTS = "ride-requests"
DRIVER_HEARTBEATS = "driver-heartbeats"
PRICE_UPDATES = "price-updates"


@dataclass(frozen=True)
class Broker:
    """A Kafka topic; needs the Kafka connector on the class path of the cluster."""

    servers: str
    topic: str
    options: dict[str, str] = field(default_factory=dict)

    def read_options(self) -> dict[str, str]:
        # A first run starts at the end of the topic; later runs go on from their checkpoint.
        return {
            "kafka.bootstrap.servers": self.servers,
            "subscribe": self.topic,
            "startingOffsets": "latest",
            **self.options,
        }

    def write_options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.servers, "topic": self.topic, **self.options}


@dataclass(frozen=True)
class Files:
    """A folder of text files, one JSON record per line."""

    path: str
    options: dict[str, str] = field(default_factory=dict)


def raw_stream(spark: SparkSession, source: Broker | Files, transport: bool = False) -> DataFrame:
    """(value, seq), with ``transport`` also the broker's topic, partition and timestamp."""
    if isinstance(source, Broker):
        records = spark.readStream.format("kafka").options(**source.read_options()).load()
        carried = ("topic", "partition", "timestamp") if transport else ()
        return records.select(F.col("value").cast("string").alias("value"), F.col("offset").alias("seq"), *carried)
    records = spark.readStream.options(**source.options).text(source.path)
    return records.select("value", _file_seq(records))


def raw_batch(spark: SparkSession, source: Files) -> DataFrame:
    records = spark.read.options(**source.options).text(source.path)
    return records.select("value", _file_seq(records))


def _file_seq(records: DataFrame):
    def number(folder: str):
        digits = F.regexp_extract(F.col("_metadata.file_path"), f"/{folder}=([0-9]+)/", 1)
        return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))

    return (number("run") * F.lit(10**9) + number("batch_id")).alias("seq")


def publish(updates: DataFrame, sink: Broker | Files, output_mode: str, run: int | None = None) -> DataStreamWriter:
    """Writer of keyed JSON price updates; the caller sets checkpoint and trigger and starts it.

    Delivery is at least once. To files each micro-batch is one folder; repeated in the same ``run``, it leaves a
    complete folder alone, which a reader may have listed. Without a ``run`` every start is a new one, and a
    micro-batch that is repeated after a failure is stored once more, as a broker would. A new checkpoint never
    meets the folders of another one.
    """
    run = new_run() if run is None else run
    writer = updates.writeStream.outputMode(output_mode)
    if isinstance(sink, Broker):
        records = updates.select(zone_key(F.col("zone_id")).alias("key"), price_update_json().alias("value"))
        return (
            records.writeStream.outputMode(output_mode).format("kafka").options(**sink.write_options())
        )

    def write(batch: DataFrame, batch_id: int) -> None:
        values = batch.select(price_update_json().alias("value"))
        write_once(values, f"{sink.path}/{batch_folder(batch, run, batch_id)}", DataFrameWriter.text)

    return writer.foreachBatch(write)


# Fixed value: what a printed update starts with.
LABEL = "PRICE-UPDATE"


def debug_lines(updates: DataFrame, label: str = LABEL) -> DataFrame:
    return updates.select(F.concat(F.lit(f"{label}> "), price_update_json()).alias("value"))


def _print_line(row: Row) -> None:
    """In one write: workers share the output, and text and line end given apart could be torn apart."""
    sys.stdout.write(row["value"] + "\n")
    sys.stdout.flush()


def debug_print(updates: DataFrame, output_mode: str) -> DataStreamWriter:
    """Writer that prints every update where it arises, as a whole line to the output of its executor."""
    return debug_lines(updates).writeStream.outputMode(output_mode).foreach(_print_line)
