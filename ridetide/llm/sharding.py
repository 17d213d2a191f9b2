"""Sharding by sampled splitters: equal sizes from size-weighted quantiles of the keys.

DataFrame operations throughout. The key of a record is a hash of its text, so equal texts lie next
to each other in key order and stay in one range, as long as that range is not overfull.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridetide.llm.common import ranked, table, written

SHARDS = 40
RECORD_BYTES = 16
LAW = "bytes"

RANGES_PER_SHARD = 64
"""Ranges wanted for each shard: the finer, the more equal the shards."""
SAMPLES_PER_RANGE = 8
"""Expected key samples for each range; their number does not depend on the number of records."""
OVERFULL = 2.0
"""A range of more than so many times its share of the bytes is subdivided."""

_CELL_BITS = 12
_SAMPLE_STEPS = 1 << 40


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key (of the text) and salt (of the record)."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("key"),
        F.xxhash64(F.lit(29), F.col("doc_id"), F.octet_length(raw)).alias("salt"),
    )


def splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Keys that cut the bytes into ranges of about equal size.

    A record is drawn with a chance in proportion to its size and stands for ``step`` bytes, or for
    its own where that is more. At most about ``ranges * SAMPLES_PER_RANGE`` keys come to the driver.
    """
    step = max(1.0, total / (ranges * SAMPLES_PER_RANGE))
    draw = F.pmod(F.xxhash64(F.lit(71), "salt", "key"), F.lit(_SAMPLE_STEPS)) / F.lit(float(_SAMPLE_STEPS))
    drawn = (
        rows.where(draw * F.lit(step) < F.col("size"))
        .groupBy("key")
        .agg(F.sum(F.greatest(F.col("size").cast("double"), F.lit(step))).alias("bytes"))
        .collect()
    )
    bounds, seen, share = [], 0.0, sum(row["bytes"] for row in drawn) / ranges
    for row in sorted(drawn, key=lambda row: row["key"]):
        seen += row["bytes"]
        if seen >= share:
            bounds.append(row["key"])
            seen = 0.0
    return bounds


def range_of(spark: SparkSession, rows: DataFrame, bounds: list[int]) -> DataFrame:
    """Add ``range``: the number of bounds below the key.

    The leading bits of a key name a cell, and a table of all cells says how many bounds lie below the
    cell and which lie in it: an equi-join against a table of fixed size instead of a comparison
    with every bound.
    """
    width = 64 - _CELL_BITS
    cells = []
    for cell in range(-(1 << _CELL_BITS - 1), 1 << _CELL_BITS - 1):
        low, high = bisect_left(bounds, cell << width), bisect_left(bounds, (cell + 1) << width)
        cells.append((cell, low, bounds[low:high]))
    lookup = spark.createDataFrame(cells, "cell long, below long, inside array<long>")
    inside = F.size(F.filter("inside", lambda bound: bound < F.col("key")))
    return (
        rows.withColumn("cell", F.shiftright("key", width))
        .join(F.broadcast(lookup), "cell")
        .withColumn("range", F.col("below") + inside)
        .drop("cell", "below", "inside")
    )


def subdivided(spark: SparkSession, rows: DataFrame, total: int, ranges: int) -> DataFrame:
    """Add ``part``: overfull ranges are cut by key, and texts that overfill a range alone by record.

    The tables that are broadcast name ranges or keys of more than a range's share of the bytes: no more
    of them than ranges.
    """
    share = max(1.0, total / ranges)
    parts = F.ceil(F.col("bytes") / share).cast("long")

    def filled(part: DataFrame, key: str, least: float) -> DataFrame:
        sums = part.groupBy(key).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > least)
        named = sums.select(key, parts.alias(f"{key}_parts")).collect()
        return spark.createDataFrame(named, f"`{key}` long, {key}_parts long")

    overfull = filled(rows, "range", OVERFULL * share)
    hot = filled(rows.join(F.broadcast(overfull), "range"), "key", share)
    marked = rows.join(F.broadcast(hot), "key", "left")
    rest = filled(marked.where("key_parts is null"), "range", OVERFULL * share)
    by_record = F.pmod(F.xxhash64(F.lit(5), "salt"), F.col("key_parts"))
    by_key = F.pmod(F.xxhash64(F.lit(6), "key"), F.coalesce("range_parts", F.lit(1)))
    return (
        marked.join(F.broadcast(rest), "range", "left")
        .withColumn("hot_key", F.when(F.col("key_parts").isNotNull(), F.col("key")))
        .withColumn("part", F.coalesce(by_record, by_key))
        .drop("key_parts", "range_parts")
    )


def balanced(sizes: list[int], shards: int) -> list[int]:
    """A shard for each part: the largest first, each to the shard with the fewest bytes."""
    heap = [(0, shard) for shard in range(shards)]
    placed = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, placed[i] = heapq.heappop(heap)
        heapq.heappush(heap, (load + sizes[i], placed[i]))
    return placed


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Put documents (doc_id, text) into ``shards`` shards of near equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text and 16), text_crc32, law, shard, slot (gapless from 0
    in its shard) and grown_shard (null under this law). Documents of equal text share a shard unless
    they alone overfill a range. A single record is never cut, so one of more than a shard's share
    makes its shard larger.

    Null text has no bytes: size 16, crc32 0. Rows with a null or repeated doc_id are records of their
    own. Other columns are not read. No documents give no rows.
    """
    spark = docs.sparkSession
    rows = written(records(docs), "records")
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = shards * RANGES_PER_SHARD
    in_range = written(range_of(spark, rows, splitters(rows, total, ranges)), "ranges")

    cut = subdivided(spark, in_range, total, ranges).withColumn("hot_key", F.coalesce("hot_key", F.lit(0)))
    unit = ["range", "hot_key", "part"]
    # A few units per range, each of about a range's bytes: bounded by the number of shards.
    units = sorted(tuple(row) for row in cut.groupBy(*unit).agg(F.sum("size")).collect())
    placed = spark.createDataFrame(
        [(*row[:3], where) for row, where in zip(units, balanced([row[3] for row in units], shards), strict=True)],
        "range long, hot_key long, part long, shard int",
    )
    numbered = ranked(
        cut.join(F.broadcast(placed), unit).select("doc_id", "size", "text_crc32", "key", "shard"),
        ["shard"],
        ["key", "doc_id"],
        "slot",
        few_groups=True,
    )
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
