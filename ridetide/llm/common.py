"""Shared parts: tables, words, written intermediate tables, gapless ranks."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import ridetide
from ridetide.session import session_conf, shared_dir

BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"

MAP_BITS = 25
"""A bitmap of 4 MB says which documents are wanted again, whatever their number."""

WORD = r"[^\x20\x09-\x0D]+"
"""What a word is: in Python, ``bytes.split()`` cuts at the same six characters."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These column names, each with as many ``_`` after it as it takes to be none of the frame's own."""
    taken = {name.lower() for name in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def read_texts(column: pa.Array) -> list[str | None]:
    """Texts of a string column; bytes that are no UTF-8 are read as replacement characters."""
    raw = column.cast(pa.large_binary()).to_pylist()
    return [None if text is None else text.decode("utf-8", "replace") for text in raw]


def text_key() -> Column:
    """A hash of the text, null as empty: with the doc_id it names a document."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def written(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and survives lost executors.

    With ``folders``, columns without nulls, a filter on one of them reads its own folders only.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors, once a session: they need not have it installed.

    From then on Python gets at most ``BATCH_ROWS`` rows at a time in this session: results that are
    computed later, when a caller asks for them, hold whole texts too.
    """
    context = spark.sparkContext
    if int(spark.conf.get(_BATCH_CONF)) > BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    if getattr(context, "_ridetide_shipped", False):
        return
    root = Path(ridetide.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="ridetide-code-")) / "ridetide.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._ridetide_shipped = True


def _place() -> Column:
    return F.pmod(F.xxhash64(F.lit(9), F.col("doc_id").cast("long")), F.lit(1 << MAP_BITS))


def id_bitmap(rows: DataFrame) -> np.ndarray:
    """A bitmap of the hashed doc_ids of the rows, of fixed size: what it lacks is not among them."""
    words = (
        rows.select(_place().alias("place"))
        .select(F.shiftright("place", 5).alias("word"), F.expr("shiftleft(1L, cast(place & 31L as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(1 << (MAP_BITS - 5), dtype=np.uint32)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return bitmap


def sifted(df: DataFrame, bitmap: np.ndarray, marked: bool) -> DataFrame:
    """The rows whose doc_id is marked in the bitmap, or those whose is not, where they are scanned.

    All of the ids of the bitmap are marked, and a few others: a join with the ids after it has only
    these rows to shuffle.
    """

    (name,) = fresh(df, "__place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch[name].to_numpy()
            bits = bitmap[place >> 5] >> (place & 31).astype(np.uint32) & 1
            yield batch.drop_columns([name]).filter(pa.array((bits == 1) == marked))

    ship_package(df.sparkSession)
    return df.withColumn(name, _place()).mapInArrow(run, df.schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """While the block plans and runs queries, Python gets so many rows at a time: texts can be long.
    The executors have this package's code from then on."""
    ship_package(spark)
    with session_conf(spark, {_BATCH_CONF: str(rows)}):
        yield


def ranked(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    rank: str,
    chunk_rows: int = 500,
    few_groups: bool = False,
) -> DataFrame:
    """Number the rows of each group from 0 without gaps, as column ``rank``.

    A group of any size is cut by a hash of ``order`` into chunks of about ``chunk_rows`` rows, so no
    task sorts a whole group. The numbering is fixed by the rows alone; rows that agree in ``order``
    are numbered among themselves in any order. ``df`` is read several times and must be stable;
    the columns of ``group`` must not be null. ``few_groups``: their number has a fixed bound, so
    their sizes are broadcast.
    """
    group, order = list(group), list(order)
    # Written, so that the join reads two plain exchanges and a hot group is split among tasks.
    chunks = written(df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("__chunks")), "chunks")
    # Dealt by chunk: else counts and windows would take over the join's partitions, which hold whole groups.
    cut = (
        df.join(F.broadcast(chunks) if few_groups else chunks, group)
        .withColumn("__chunk", F.pmod(F.xxhash64(F.lit(11), *order), F.col("__chunks")))
        .drop("__chunks")
        .repartition(*group, "__chunk")
    )
    before = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*group, "__chunk")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    within = Window.partitionBy(*group, "__chunk").orderBy(*order)
    return (
        cut.withColumn("__row", F.row_number().over(within) - 1)
        .join(starts, [*group, "__chunk"])
        .withColumn(rank, F.col("__row") + F.col("__start"))
        .drop("__row", "__start", "__chunk")
    )
