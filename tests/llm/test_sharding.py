from __future__ import annotations

import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from ridetide.llm.common import table
from ridetide.llm.sharding import balanced, shard


def check(rows, texts, shards):
    """Sizes and checksums; slots gapless; returns the bytes of each shard."""
    slots = defaultdict(list)
    for row in rows:
        raw = (texts[row["doc_id"]] or "").encode()
        assert (row["size"], row["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        assert row["law"] == "bytes" and row["grown_shard"] is None and 0 <= row["shard"] < shards
        slots[row["shard"]].append((row["slot"], row["size"]))
    for own in slots.values():
        assert sorted(slot for slot, _ in own) == list(range(len(own)))
    return [sum(size for _, size in slots[k]) for k in range(shards)]


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = shard(docs).collect()
    assert len(rows) == len(texts)
    loads = check(rows, texts, 40)
    assert max(loads) <= 1.02 * sum(loads) / 40
    again = shard(docs.repartition(3)).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_hot_text_is_subdivided(spark):
    """Two thirds of the rows are equal: they still spread evenly."""
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 < 2, F.lit("same text")).otherwise(F.concat(F.lit("text "), "id")).alias("text"),
        F.lit("x").alias("shard"),
        F.lit(1).alias("size"),
    )
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    loads = check(shard(docs).collect(), texts, 40)
    assert max(loads) <= 1.1 * sum(loads) / 40


def test_small_groups_stay_together(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 2000).alias("text"))
    together = defaultdict(set)
    for row in shard(docs, 4).collect():
        together[row["doc_id"] % 2000].add(row["shard"])
    assert all(len(own) == 1 for own in together.values())


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "é" * 40_000, None: "a", 5: "a"}
    docs = spark.createDataFrame([*texts.items(), *texts.items()], "doc_id long, text string")
    rows = shard(docs, 3).collect()
    assert len(rows) == 10
    check(rows, texts, 3)
    assert shard(docs.where(F.lit(False))).count() == 0


def test_largest_first():
    loads = defaultdict(int)
    for size, where in zip([7, 5, 4, 4], balanced([7, 5, 4, 4], 2), strict=True):
        loads[where] += size
    assert sorted(loads.values()) == [9, 11]
