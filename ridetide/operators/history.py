"""History, audit and zone listings over the window table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridetide.functions.instants import instant, iso_text, now_ms
from ridetide.operators.latest import HISTORY_COLUMNS
from ridetide.params import AUDIT_RECORDS, HISTORY_HOURS, READ_ZONES, RECENT_WINDOWS

# Default of a plain parameter: windows in one returned list; a longer range comes as several pages.
PAGE_WINDOWS = 1_000

WINDOW_FIELDS = tuple(name for name in HISTORY_COLUMNS if name not in ("zone_id", "ts_compute"))


def newest_first() -> Column:
    return F.desc("window_start")


def zone_rows(table: DataFrame, zone_id: int | None) -> DataFrame:
    """Primary-key lookup, pushed to the scan; all zones when no zone is given."""
    return table if zone_id is None else table.filter(F.col("zone_id") == F.lit(zone_id))


def in_range(history: DataFrame, from_ms: int, to_ms: int, zone_id: int | None = None) -> DataFrame:
    """Windows that lie fully inside the range, both ends included.

    A window starts before it ends, so its start is bounded on both sides; that condition reaches
    the scan of a stored history, whose key is the start.
    """
    low, high = instant(from_ms), instant(to_ms)
    start, end = F.col("window_start"), F.col("window_end")
    return zone_rows(history, zone_id).filter((start >= low) & (start < high) & (end <= high))


def history_range(history: DataFrame, from_ms: int, to_ms: int, zone_id: int | None = None) -> DataFrame:
    return in_range(history, from_ms, to_ms, zone_id).orderBy("zone_id", newest_first())


def history_full(history: DataFrame, zone_id: int | None = None) -> DataFrame:
    return zone_rows(history, zone_id).orderBy("zone_id", newest_first())


def history_recent(history: DataFrame, n: int = RECENT_WINDOWS, zone_id: int | None = None) -> DataFrame:
    """Newest n windows per zone. Each task keeps n rows per zone before the shuffle."""
    if zone_id is not None:
        return zone_rows(history, zone_id).orderBy(newest_first()).limit(n)
    newest = Window.partitionBy("zone_id").orderBy(newest_first())
    return history.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= n).drop("__n")


def _window_list():
    """Windows of a group, newest first."""
    window = F.struct(*WINDOW_FIELDS, F.col("ts_compute").alias("computed_at"))
    return F.reverse(F.array_sort(F.collect_list(window)))


def rollup_recent(recent: DataFrame) -> DataFrame:
    """One response per zone from rows that ``history_recent`` has already bounded.

    The range is the one the rows span: start of the oldest, end of the newest.
    """
    return recent.groupBy("zone_id").agg(
        F.min("window_start").alias("from"),
        F.max("window_end").alias("to"),
        F.count(F.lit(1)).alias("total_windows"),
        _window_list().alias("metrics"),
    )


def rollup_range(
    history: DataFrame,
    from_ms: int,
    to_ms: int,
    window_ms: int,
    zone_id: int | None = None,
    page_windows: int = PAGE_WINDOWS,
) -> DataFrame:
    """Responses for a range, in pages that cut it by time, newest page first.

    A page spans ``page_windows`` windows, so no list grows with the range, and a range that fits
    one page gives one row per zone. ``total_windows`` counts the whole range, on every page, and
    ``page_windows`` the list. The totals are counted apart, so that no zone's lists meet in one task.
    """
    rows = in_range(history, from_ms, to_ms, zone_id)
    age_ms = F.lit(to_ms) - F.unix_millis("window_end")
    page = F.floor(age_ms / F.lit(window_ms * page_windows)).cast("bigint")
    pages = rows.groupBy("zone_id", page.alias("page")).agg(
        instant(from_ms).alias("from"),
        instant(to_ms).alias("to"),
        F.count(F.lit(1)).alias("page_windows"),
        _window_list().alias("metrics"),
    )
    totals = rows.groupBy(F.col("zone_id").alias("__zone")).agg(F.count(F.lit(1)).alias("total_windows"))
    return pages.join(totals, F.col("zone_id") == F.col("__zone")).select(
        "zone_id", "page", "from", "to", "total_windows", "page_windows", "metrics"
    )


def zone_history(
    history: DataFrame,
    zone_id: int,
    window_ms: int,
    from_ms: int | None = None,
    to_ms: int | None = None,
    as_of_ms: int | None = None,
) -> DataFrame:
    """History response of one zone.

    Without bounds the newest windows; with one bound the other is now, or a day before the end.
    A zone without windows still gets its response, with an empty list.
    """
    low, high = READ_ZONES
    if not low <= zone_id <= high:
        raise ValueError(f"zone_id not in {low}..{high}")
    to = next(ms for ms in (to_ms, as_of_ms, now_ms()) if ms is not None)
    start = from_ms if from_ms is not None else to - HISTORY_HOURS * 3_600_000
    if from_ms is None and to_ms is None:
        found = rollup_recent(history_recent(history, zone_id=zone_id)).withColumns(
            {"page": F.lit(0).cast("bigint"), "page_windows": F.col("total_windows")}
        )
    else:
        found = rollup_range(history, start, to, window_ms, zone_id)
    asked = history.sparkSession.range(zone_id, zone_id + 1).select(F.col("id").cast("int").alias("zone_id"))
    return (
        asked.join(found, "zone_id", "left")
        .select(
            "zone_id",
            F.coalesce("page", F.lit(0).cast("bigint")).alias("page"),
            F.coalesce("from", instant(start)).alias("from"),
            F.coalesce("to", instant(to)).alias("to"),
            F.coalesce("total_windows", F.lit(0).cast("bigint")).alias("total_windows"),
            F.coalesce("page_windows", F.lit(0).cast("bigint")).alias("page_windows"),
            F.coalesce("metrics", F.array().cast(found.schema["metrics"].dataType)).alias("metrics"),
        )
        .orderBy("page")
    )


def audit_records(history: DataFrame, limit: int = AUDIT_RECORDS) -> DataFrame:
    """Newest records of all zones. Compute times tie across zones; the zone breaks ties."""
    newest = history.orderBy(F.desc("ts_compute"), "zone_id", newest_first()).limit(limit)
    return newest.select(
        "zone_id",
        iso_text(F.col("window_start"), always_seconds=False).alias("window_start"),
        iso_text(F.col("window_end"), always_seconds=False).alias("window_end"),
        "demand",
        "supply",
        F.col("ratio").cast("double").alias("ratio"),
        F.col("surge_multiplier").cast("double").alias("surge_multiplier"),
        iso_text(F.col("ts_compute"), always_seconds=False).alias("ts_compute"),
    )


def zones_listing(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("zone_id", "surge_multiplier", "demand", "supply", "ratio", "updated_at")


def surge_only(snapshot: DataFrame) -> DataFrame:
    return zones_listing(snapshot).filter(F.col("surge_multiplier") > F.lit(1))


def with_count(listing: DataFrame) -> DataFrame:
    """How many entries a listing returns."""
    return listing.agg(F.count(F.lit(1)).alias("count"))
