"""Last-write-wins tables as views over append-only rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridetide.functions.instants import instant, to_millis
from ridetide.operators.asof import as_of
from ridetide.schemas import ZONE_PRICE_SNAPSHOT, ZONE_WINDOW_METRICS, column_names

HISTORY_COLUMNS = column_names(ZONE_WINDOW_METRICS)
SNAPSHOT_COLUMNS = column_names(ZONE_PRICE_SNAPSHOT)

_SEQ_DIGITS, _BATCH_DIGITS = 19, 9


def last_by(rows: DataFrame, keys: tuple[str, ...], order: Column | str) -> DataFrame:
    """One row per key: the one with the greatest ``order``, a number without ties within a key.

    An aggregate with map-side combine, so a key with a third of the rows costs one row per task;
    a ranking window would move and sort them all. Each column is picked on its own: fixed-width
    columns make it a hash aggregate, while a struct would need a sort.
    """
    rest = [name for name in rows.columns if name not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(name, order).alias(name) for name in rest])


def snapshot_of_history(history: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """Latest window per zone of a history that has one row per zone and window.

    ``window_start`` has no ties within a zone, so each column can be picked on its own. Scalar
    picks keep the aggregate a hash aggregate; a struct would need a sort.
    """
    picked = [name for name in SNAPSHOT_COLUMNS if name not in ("zone_id", "window_start", "updated_at")]
    return (
        history.groupBy("zone_id")
        .agg(
            *[F.max_by(name, "window_start").alias(name) for name in picked],
            F.max("window_start").alias("window_start"),
        )
        .withColumn("updated_at", instant(as_of_ms))
        .select(*SNAPSHOT_COLUMNS)
    )


def _then(order: Column, digits: int, tie: Column) -> Column:
    """Append a number of at most so many digits to a number that orders rows."""
    return order.cast("decimal(38,0)") * F.lit(Decimal(10**digits)) + tie.cast("decimal(38,0)")


def arrival() -> Column:
    """Run, micro-batch and position of a log row as one number of 38 digits, of them ten for the run.

    No two versions of a window agree in it: a micro-batch holds a window once, unless its rows come from
    several records, which have positions of their own.
    """
    in_run = _then(F.col("run"), _BATCH_DIGITS, F.col("batch_id"))
    return _then(in_run, _SEQ_DIGITS, F.col("seq"))


def last_versions(log: DataFrame) -> DataFrame:
    """Last version of each (zone, window_start), by arrival, in the columns of the log."""
    return last_by(log, ("zone_id", "window_start"), arrival()).select(*log.columns)


def last_of_zones(versions: DataFrame, by_event_time: bool = False) -> DataFrame:
    """Of rows with one version per zone and window: the last arrival of each zone, the newest
    window among equal arrivals; or the newest window."""
    window = F.unix_millis("window_start")
    if by_event_time:
        return last_by(versions, ("zone_id",), window).select(*versions.columns)
    # The newest window of each arrival, then the last arrival: both are hash aggregates.
    of_arrival = last_by(versions.withColumn("__arrival", arrival()), ("zone_id", "__arrival"), window)
    return last_by(of_arrival, ("zone_id",), "__arrival").select(*versions.columns)


def history_of_log(log: DataFrame) -> DataFrame:
    return last_versions(log).select(*HISTORY_COLUMNS)


def snapshot_of_log(log: DataFrame, by_event_time: bool = False) -> DataFrame:
    """Current row per zone.

    By default whatever arrived last wins, also a late correction of an older window. Inside one
    arrival the newest window wins. ``by_event_time`` lets the newest window win always.
    """
    latest = last_of_zones(last_versions(log), by_event_time)
    return latest.withColumnRenamed("received_at", "updated_at").select(*SNAPSHOT_COLUMNS)


def with_seed(history: DataFrame, seed: DataFrame) -> DataFrame:
    """Versions of the snapshot: every window from the moment it was computed, and the seed rows."""
    computed = history.withColumnRenamed("ts_compute", "updated_at").select(*SNAPSHOT_COLUMNS)
    return computed.unionByName(seed.select(*SNAPSHOT_COLUMNS))


def snapshot_as_of(asked: DataFrame, versions: DataFrame, at: str, cell_ms: int) -> DataFrame:
    """The snapshot row of each zone asked for, as it was at the moment ``at``; none if there was none yet."""
    columns = [name for name in SNAPSHOT_COLUMNS if name != "zone_id"]
    facts = {"row": (versions, to_millis(F.col("updated_at")), columns)}
    found = as_of(asked, "zone_id", at, facts, cell_ms).where("row is not null")
    return found.select(*asked.columns, *[F.col(f"row.{name}").alias(name) for name in columns])
