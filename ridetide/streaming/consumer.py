"""The table job: price updates -> update log -> change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ridetide.functions.instants import instant
from ridetide.operators.feeds import all_zones_feed, zone_feed
from ridetide.operators.normalize import decode_price_updates, to_table_types
from ridetide.session import batch_folder, new_run, write_once
from ridetide.streaming.store import UpdateLog


def log_rows(updates: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """Wire updates with ``seq`` -> rows of the update log."""
    return to_table_types(updates).withColumn("received_at", instant(as_of_ms))


def store_updates(
    updates: DataFrame, log: UpdateLog, output_mode: str, as_of_ms: int | None = None, run: int | None = None
) -> DataStreamWriter:
    """Writer that stores the updates of a pricing job directly, without a broker between.

    Without a ``run`` every start is a new one, which comes after all before it.
    """
    run = new_run() if run is None else run

    def write(batch: DataFrame, batch_id: int) -> None:
        log.append(log_rows(batch.withColumn("seq", F.lit(0).cast("bigint")), as_of_ms), batch_id, run)

    return updates.writeStream.outputMode(output_mode).foreachBatch(write)


def consume(
    raw: DataFrame,
    log: UpdateLog,
    as_of_ms: int | None = None,
    feed_path: str | None = None,
    subscriptions: DataFrame | None = None,
    run: int | None = None,
) -> DataStreamWriter:
    """Writer that decodes raw price updates (``value``, ``seq``), stores them and writes feeds.

    An unusable payload fails the query; it goes on from the same micro-batch when restarted. A
    micro-batch that is repeated in the same ``run`` leaves the log and feed folders alone that are complete.
    Without a ``run`` every start is a new one, which comes after all before it.
    """
    run = new_run() if run is None else run

    def write_feeds(updates: DataFrame, batch_id: int) -> None:
        part = batch_folder(updates, run, batch_id)
        feed = all_zones_feed(updates, as_of_ms).select("value")
        write_once(feed, f"{feed_path}/all/{part}", DataFrameWriter.text)
        if subscriptions is not None:
            zones = zone_feed(updates, subscriptions, as_of_ms)
            by_zone = lambda writer, folder: writer.partitionBy("zone_id").text(folder)
            write_once(zones, f"{feed_path}/zones/{part}", by_zone)

    def write(batch: DataFrame, batch_id: int) -> None:
        updates = decode_price_updates(batch, carry=("seq",))
        if feed_path is None:
            log.append(log_rows(updates, as_of_ms), batch_id, run)
            return
        # Read and decoded once for the log and the feeds; lost blocks are computed again.
        updates = updates.persist()
        try:
            log.append(log_rows(updates, as_of_ms), batch_id, run)
            write_feeds(updates, batch_id)
        finally:
            updates.unpersist()

    return raw.writeStream.foreachBatch(write)
