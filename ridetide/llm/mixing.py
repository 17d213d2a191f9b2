"""Mixing sources to target weights by fitting each source's budget as a subset sum."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridetide.llm.common import WORD, ranked, ship_package, table, text_key, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_TIMES = 2
SEED = 20
DP_WORDS = 50_000
"""The first pass leaves so many words to the dynamic program."""
TABLE_BITS = 1 << 30
"""Where the first pass misses, all documents are open to a table of so many bits, or, for few documents of
any length, to lists of so many sums:"""
MOST_SUMS = 1 << 23


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        text_key().alias("text_key"),
    )


def weighted(spark: SparkSession, sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, source_no (by code point, null last) and weight, one row per source."""
    last = F.asc_nulls_last("source")
    parts = written(
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .repartitionByRange(last)
        .withColumn("part", F.spark_partition_id()),
        "sources",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    number = F.row_number().over(Window.partitionBy("part").orderBy(last)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    return (
        parts.withColumn("number", number)
        .join(starts, "part")
        .withColumn("source_no", F.col("number") + F.col("start"))
        .withColumn("weight", weight)
        .select("source", "source_size", "source_no", "weight")
    )


def targeted(sources: DataFrame, share: float = SHARE, most: int = MOST_TIMES) -> DataFrame:
    """Add ``target``: the budget by weight, none above ``most`` times its source.

    What a source cannot take is shared out by weight among the others until none is above; only
    sums come to the driver.
    """
    budget = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    ceiling = F.col("source_size") * F.lit(float(most))
    level, full = 0.0, F.lit(False)
    while True:
        spent, open_weight, capped = sources.agg(
            F.coalesce(F.sum(F.when(full, ceiling)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.count_if(full),
        ).first()
        if not open_weight:
            break
        level = (budget - spent) / open_weight
        full = F.col("weight") * F.lit(level) > ceiling
        if sources.where(full).count() == capped:
            break
    return sources.withColumn("target", F.when(full, ceiling).otherwise(F.col("weight") * F.lit(level)))


def fit(budget: int, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many documents of each size to take so that their words come as near ``budget`` as can be.

    Every size first gives the share of its documents that the budget is of all words, so that the choice
    has the source's mix of lengths. Then sizes in seeded order give one more document each until
    ``DP_WORDS`` are left, and ``reach`` fits these. Where that misses, all documents are open to the
    dynamic program, which finds the nearest sum there is, as a table of bits or as a list of sums. Only
    where both are too large, which takes both many documents and long ones, it gets the documents back
    that were taken last, as many as the table allows.
    """
    words = int(sizes @ counts)
    if budget <= 0 or not words:
        return np.zeros(len(sizes), dtype=np.int64)
    if budget >= words:
        return counts.copy()
    spare = min(budget // 10, DP_WORDS // 2)
    take = np.floor(counts * ((budget - spare) / words)).astype(np.int64)
    left = budget - int(take @ sizes)
    order = np.random.default_rng(SEED).permutation(np.flatnonzero(sizes))
    for i in order:
        if left <= DP_WORDS:
            break
        if take[i] < counts[i] and sizes[i] <= left:
            take[i] += 1
            left -= int(sizes[i])
    items = sum(min(int(counts[i]), 2 * budget // int(sizes[i])).bit_length() for i in order)
    room = max(DP_WORDS, TABLE_BITS // (2 * max(items, 1)))
    first, off = take, lambda amounts: abs(int(amounts @ sizes) - budget)
    if left <= room:  # documents longer than the table are left to the list
        take = first + reach(left, sizes, counts - first, order)
    step = int(np.gcd.reduce(sizes[order]))
    if off(take) == min(budget % step, -budget % step):  # every sum is a multiple of the step
        return take
    if budget <= room:
        return reach(budget, sizes, counts, order)
    nearest = listed_reach(budget, sizes, counts, order)
    return nearest if nearest is not None else min(take, reopened(budget, sizes, counts, first, order, room), key=off)


def reopened(
    budget: int, sizes: np.ndarray, counts: np.ndarray, take: np.ndarray, order: np.ndarray, room: int
) -> np.ndarray:
    """``take`` with its last documents given back, up to ``room`` words, and these words fitted anew."""
    kept, left = take.copy(), budget - int(take @ sizes)
    for i in order[::-1]:
        back = min(int(kept[i]), max(0, room - left) // int(sizes[i]))
        kept[i] -= back
        left += back * int(sizes[i])
    if left > room:
        return take
    return kept + reach(left, sizes, counts - kept, order)


def listed_reach(budget: int, sizes: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray | None:
    """``reach`` over lists of the sums, whose length depends on the documents only; None above ``MOST_SUMS``."""
    sums, steps, held = np.zeros(1, dtype=np.int64), [], 1
    has = lambda values, value: values[min(int(np.searchsorted(values, value)), len(values) - 1)] == value
    for i in order:
        size, times = int(sizes[i]), 1
        spare = min(int(counts[i]), 2 * budget // size)
        while spare > 0 and not has(sums, budget):
            times = min(times, spare)
            steps.append((i, times, sums))
            more = sums + size * times
            sums = np.union1d(sums, more[more <= 2 * budget])
            held += len(sums)
            if held > MOST_SUMS:
                return None
            spare -= times
            times *= 2
    take, reached = np.zeros(len(sizes), dtype=np.int64), int(sums[np.abs(sums - budget).argmin()])
    for i, times, before in reversed(steps):
        if not has(before, reached):
            take[i] += times
            reached -= times * int(sizes[i])
    return take


def reach(budget: int, sizes: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bounded knapsack: the amounts of sizes whose sum is nearest to ``budget``, from below or above.

    Sums that can be reached are the bits of a number; items are powers of two of a size's documents.
    It stops at the first exact fit.
    """
    take = np.zeros(len(sizes), dtype=np.int64)
    most = 2 * budget
    limit = (1 << (most + 1)) - 1
    sums, steps = 1, []
    for i in order:
        size, times = int(sizes[i]), 1
        spare = min(int(counts[i]), most // size)
        while spare > 0 and not sums >> budget & 1:
            times = min(times, spare)
            steps.append((i, times, sums))
            sums |= (sums << size * times) & limit
            spare -= times
            times *= 2
    below = (sums & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = sums >> (budget + 1)
    nearest_above = budget + 1 + ((above & -above).bit_length() - 1) if above else None
    reached = below if nearest_above is None or budget - below <= nearest_above - budget else nearest_above
    for i, times, before in reversed(steps):
        if not before >> reached & 1:
            take[i] += times
            reached -= times * int(sizes[i])
    return take


def amounts(histogram: DataFrame) -> DataFrame:
    """Per source and size: how many of its documents are taken once more than ``base`` times."""

    def fitted(rows: pa.Table) -> pa.Table:
        budget = rows["budget"][0].as_py()
        rows = rows.sort_by("size")
        take = fit(budget, rows["size"].to_numpy(), rows["n"].to_numpy())
        return rows.select(["source_no", "size"]).append_column("take", pa.array(take, pa.int64()))

    return histogram.groupBy("source_no").applyInArrow(fitted, "source_no long, size long, take long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """Take documents (doc_id, text, source) so that each source comes to its target of words.

    Returns doc_id, size, source_size, target, taken (0, 1 or 2 times the size), times and text_key, a
    hash of the text. A source whose
    target exceeds its size is taken whole, and the rest of the target once more. Only counts by source
    and exact length reach the dynamic program; documents of a length are chosen in seeded order.

    Null text has size 0; documents of size 0 have taken 0. A null source is a source, the last one. Rows
    with a null or repeated doc_id are documents of their own. Other columns are not read. No documents
    give no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sizes = written(sized(docs), "sizes")
    sources = written(targeted(weighted(spark, sizes, weights), share), "targets")
    rows = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select(
        "doc_id", "text_key", "size", "source_no", "source_size", "target"
    )
    # A target is met at a whole number of words.
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    base = F.least(whole, F.lit(MOST_TIMES))
    histogram = (
        rows.groupBy("source_no", "size")
        .agg(F.count(F.lit(1)).alias("n"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
        .withColumn("budget", F.round(F.col("target") - base * F.col("source_size")).cast("long"))
        .select("source_no", "size", "n", "budget")
    )
    takes = written(amounts(histogram), "takes")
    numbered = ranked(
        written(rows.withColumn("seeded", F.xxhash64(F.lit(seed), "doc_id", "text_key")), "sized"),
        ["source_no", "size"],
        ["seeded", "doc_id", "text_key"],
        "nth",
    )
    times = base + (F.col("nth") < F.col("take")).cast("long")
    chosen = numbered.join(takes, ["source_no", "size"]).withColumn("times", F.when(F.col("size") > 0, times).otherwise(0))
    return chosen.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("times")).alias("taken"),
        "times",
        "text_key",
    )


def _key_of(text: Column) -> Column:
    """As ``text_key``, of a text that lies elsewhere."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The documents as often as the mix takes them, in the columns given, whatever their names.

    Rows of one id and text are told apart by their other columns, and if these agree too, which of them is
    which is all the same; columns of maps tell nothing apart.
    """
    amount = mix(docs, weights, share, seed)
    # Rows of one id and text are told apart by a number, which of them is which being all the same.
    key = ["doc_id", "text_key"]
    numbered = amount.select(
        F.col("doc_id").alias("__doc_id"),
        F.col("text_key").alias("__key"),
        F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("times"))).alias("__nth"),
        F.col("times").alias("__times"),
    ).where("__times > 0")
    given = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("given"))
    others = [f"given.`{f.name}`" for f in docs.schema.fields if f.name != "text" and "map<" not in f.dataType.simpleString()]
    told = given.withColumn("order", F.xxhash64(*[F.col(name) for name in others]))
    keyed = told.withColumn("key", _key_of(F.col("given.text"))).withColumn("id", F.col("given.doc_id").cast("long"))
    order = [F.col("given.source")] if "source" in docs.columns else []
    own = Window.partitionBy("id", "key").orderBy(*order, "order")
    rows = keyed.withColumn("row", F.row_number().over(own)).select("given", "id", "key", "row")
    same = rows["id"].eqNullSafe(numbered["__doc_id"]) & (rows["key"] == numbered["__key"]) & (rows["row"] == numbered["__nth"])
    taken = rows.join(numbered, same).withColumn("copy", F.explode(F.sequence(F.lit(1), "__times")))
    return taken.select("given.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
