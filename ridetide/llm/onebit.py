"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridetide.llm.common import ship_package, small_batches, table, written
from ridetide.llm.vectors import main_dimension, usable

NEAREST = 20
BOUND = 3.5
"""Width of the error bound in standard deviations of the estimate."""
BITS = 4
"""Bits for each component: vectors are rotated together with so many times as many zeros, which narrows
the bound by the square root."""
CENTERS = 32
SAMPLE = 4096
"""Centres are fitted on at most so many vectors; every vector is coded."""
BLOCK_ROWS = 8192
BLOCK_QUERIES = 512
SEED = 17


def rotation(dimension: int) -> np.ndarray:
    """What a random rotation of ``BITS * dimension`` components does to the first ``dimension`` of them."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((BITS * dimension, dimension)))
    return q * np.sign(np.diagonal(r))


def centres(sample: np.ndarray, count: int = CENTERS, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from spread starting points."""
    count = min(count, len(sample))
    found = sample[np.random.default_rng(SEED).choice(len(sample), count, replace=False)].copy()
    for _ in range(rounds):
        nearest = (((found**2).sum(axis=1) - 2 * sample @ found.T)).argmin(axis=1)
        for k in range(count):
            if (nearest == k).any():
                found[k] = sample[nearest == k].mean(axis=0)
    return found


class Codes:
    """One bit per rotated component of each vector's offset from its centre, and correction scalars.

    With x the rotated unit offset and s its signs over sqrt(D): <offset, q> is estimated by
    |offset| <s, q'> / <s, x>, q' the rotated query less the centre, D the number of bits. The error is about
    |offset| |q'| sqrt((1 - <s, x>^2) / <s, x>^2 / (D - 1)) times a standard normal.
    """

    def __init__(self, vectors: np.ndarray, middle: np.ndarray, turn: np.ndarray):
        self.middle, self.turn = middle, turn
        self.centre = ((middle**2).sum(axis=1) - 2 * vectors @ middle.T).argmin(axis=1)
        offset = vectors - middle[self.centre]
        self.norm = np.sqrt((offset**2).sum(axis=1))
        turned = (offset / np.where(self.norm > 0, self.norm, 1)[:, None]) @ turn.T
        self.width = turn.shape[0]
        self.bits = np.packbits(turned > 0, axis=1)
        self.fit = np.abs(turned).sum(axis=1) / math.sqrt(self.width)
        self.at_centre = (offset * middle[self.centre]).sum(axis=1)

    def bounds(self, queries: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of all queries with all coded vectors, and how far off they may be."""
        signs = np.unpackbits(self.bits, axis=1, count=self.width).astype(np.float32)
        signs = (2 * signs - 1) / np.float32(math.sqrt(self.width))
        turned = (queries @ self.turn.T).astype(np.float32)
        turned_middle = (self.middle @ self.turn.T).astype(np.float32)
        shift = (signs * turned_middle[self.centre]).sum(axis=1)
        fit = np.where(self.fit > 0, self.fit, 1).astype(np.float32)
        scale = (self.norm / fit).astype(np.float32)
        along = turned @ signs.T - shift
        to_centre = queries @ self.middle.T
        estimate = along * scale + (to_centre[:, self.centre] + self.at_centre).astype(np.float32)
        distance = np.sqrt(
            np.maximum((queries**2).sum(axis=1)[:, None] - 2 * to_centre + (self.middle**2).sum(axis=1), 0)
        )
        spread = self.norm * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / math.sqrt(max(1, self.width - 1))
        error = width * distance[:, self.centre] * spread
        return estimate, error.astype(np.float32)


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in the order of the components: equal vectors get
    equal results wherever they stand."""
    total = np.zeros(len(vectors))
    for products in (vectors * query).T:
        total += products
    return total


def reranked(codes: Codes, vectors: np.ndarray, queries: np.ndarray, ids: np.ndarray, most: int, width: float):
    """For each query: indices and exact inner products of its ``most`` best, by (product, -id).

    The best estimates are computed first; their least product is what another vector's upper bound must
    reach to be computed too.
    """
    estimate, error = codes.bounds(queries, width)
    upper = estimate + error
    take = min(len(vectors), most)
    for q, query in enumerate(queries):
        first = np.argpartition(-estimate[q], take - 1)[:take]
        floor = inner(vectors[first], query).min() if take == most else -np.inf
        rest = np.flatnonzero(upper[q] >= floor)
        chosen = np.union1d(first, rest)
        products = inner(vectors[chosen], query)
        order = np.lexsort((ids[chosen], -products))[:take]
        yield chosen[order], products[order]


def matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def packed(kind: str):
    """A block of rows as one row: ids and vectors as bytes."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("class_id")
        return pa.table(
            {
                "block": pa.array([block["block"][0].as_py()], pa.int64()),
                f"{kind}_ids": pa.array([block["class_id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                f"{kind}_vectors": pa.array([matrix(block["vector"]).astype("<f8").tobytes()], pa.binary()),
            }
        )

    return run


def searched(middle: np.ndarray, dimension: int, most: int, width: float):
    """One block of queries against one block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dimension)
        for batch in batches:
            for row in batch.to_pylist():
                ids, query_ids = (np.frombuffer(row[f"{kind}_ids"], "<i8") for kind in ("row", "query"))
                vectors, queries = (
                    np.frombuffer(row[f"{kind}_vectors"], "<f8").reshape(-1, dimension) for kind in ("row", "query")
                )
                found = list(reranked(Codes(vectors, middle, turn), vectors, queries, ids, most, width))
                lengths = [len(own) for own, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(query_ids, lengths), pa.int64()),
                        pa.array(ids[np.concatenate([own for own, _ in found])], pa.int64()),
                        pa.array(np.concatenate([products for _, products in found]), pa.float64()),
                    ],
                    names=["query_class", "class_id", "score"],
                )

    return run


def search(
    vectors: DataFrame, is_query: Column, nearest: int = NEAREST, width: float = BOUND, centers: int = CENTERS
) -> DataFrame:
    """For each query row of vectors (vec_id, embedding): the rows of largest inner product but itself.

    Returns query_id, rank (from 1), vec_id and score, nearest first, ties to the smaller vec_id; fewer than
    ``nearest`` only where there are fewer rows. Equal vectors form a class that is compared once. Blocks
    of query classes meet blocks of row classes; in each, one-bit codes give bounds for all products, and
    exact ones are computed only where the bound reaches the best found. A block keeps ``nearest`` and one
    per query, so the exchange after it does not depend on the block's size.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of
    other than the most frequent number of components, nor rows with a null id. A repeated vec_id is one
    row per occurrence as a neighbour, and one query. Other columns are not read. No vectors give no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    ).where(usable("vector") & F.col("vec_id").isNotNull())
    dimension = main_dimension(given, "vector")
    given = given.where(F.size("vector") == dimension)
    keep = nearest + 1
    # The first ids of a class are all that one query can return of it; the limit applies before the exchange.
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    classes = written(
        given.select("vec_id", "vector")
        .withColumn("nth", first)
        .where(F.col("nth") <= keep)
        .groupBy("vector")
        .agg(F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "vector_classes",
    )
    asked = written(
        given.where("is_query")
        .select(F.col("vec_id").alias("query_id"), "vector")
        .distinct()
        .join(classes.select("vector", "class_id"), "vector")
        .select("query_id", F.col("class_id").alias("query_class")),
        "queries",
    )
    asked_classes = classes.join(asked.select(F.col("query_class").alias("class_id")).distinct(), "class_id")

    fitted = classes.orderBy(F.xxhash64(F.lit(SEED), "class_id")).limit(SAMPLE).select("vector").toArrow()
    middle = centres(matrix(fitted["vector"]), centers) if fitted.num_rows else np.zeros((1, max(1, dimension)))

    def blocks(rows: DataFrame, kind: str, size: int) -> tuple[DataFrame, int]:
        count = max(1, math.ceil(rows.count() / size))
        numbered = rows.select("class_id", "vector", F.pmod(F.xxhash64(F.lit(2), "class_id"), F.lit(count)).alias("block"))
        schema = f"block long, {kind}_ids binary, {kind}_vectors binary"
        return written(numbered.groupBy("block").applyInArrow(packed(kind), schema), f"{kind}_blocks"), count

    row_blocks, _ = blocks(classes, "row", BLOCK_ROWS)
    query_blocks, query_count = blocks(asked_classes, "query", BLOCK_QUERIES)
    # Each block of rows goes to each block of queries: one task per pair of blocks.
    pairs = (
        row_blocks.withColumnRenamed("block", "row_block")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_count - 1).cast("long"))))
        .join(query_blocks, "block")
        .repartition("row_block", "block")
        .select("row_ids", "row_vectors", "query_ids", "query_vectors")
    )
    with small_batches(spark, 1):
        found = written(
            pairs.mapInArrow(searched(middle, dimension, keep, width), "query_class long, class_id long, score double"),
            "found",
        )
    best = Window.partitionBy("query_class").orderBy(F.desc("score"), "class_id")
    near = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= keep).drop("nth")
    listed = near.join(classes.select("class_id", "ids"), "class_id").select(
        "query_class", "score", F.explode("ids").alias("vec_id")
    )
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(listed, "query_class")
        .where("vec_id != query_id")
        .withColumn("rank", F.row_number().over(own))
        .where(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )


def op10_onebit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
