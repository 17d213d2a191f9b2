"""Line dedup: levelled sorted runs of line hashes that every batch of documents is anti-joined with.

DataFrame operations throughout. A line is known by its key: the line without blanks at its ends and with
A-Z in lower case. A run is a sorted table with one row per key hash: the number of documents that hold the
key and the greatest doc_id among them.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridetide.llm.common import table, text_key, written

LEAST_CHARS = 20
"""Lines with shorter keys stay."""
LEAST_DOCS = 3
"""A key is repeated when so many documents hold it."""
BATCHES = 4
"""Batches that the documents are dealt to, by doc_id, the greatest first."""
FAN = 2
"""So many runs of one level are folded into one run of the next."""

BLANK = " \t\n\x0b\f\r"
HASH = ["hash", "check"]
"""64 bits of one hash of the key and 32 of another."""

_MAP_BITS = 25


def line_key(line: Column) -> Column:
    """Lower case for A-Z alone: for a line of plain ASCII that is ``lower``, which is faster."""
    bare = F.btrim(line, F.lit(BLANK))
    lowered = F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(lowered)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def keyed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, text_key, position, hash, check) of every line whose key is long enough."""
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.posexplode(_lines(F.col("text")))
    ).where("doc_id is not null")
    key = F.col("key")
    return (
        lines.select("doc_id", "text_key", F.col("pos").alias("position"), line_key(F.col("col")).alias("key"))
        .where(F.char_length(key) >= least_chars)
        .select(
            "doc_id", "text_key", "position", F.xxhash64(key).alias("hash"), (F.crc32(key) - F.lit(1 << 31)).cast("int").alias("check")
        )
    )


def run_of(lines: DataFrame) -> DataFrame:
    """(hash, check, docs, last): documents that hold the line, rows of one doc_id counted once.

    A line that a third of the documents hold reaches the last shuffle as one row per task.
    """
    held = lines.select(*HASH, "doc_id").distinct()
    return held.groupBy(*HASH).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))


class SortedRuns:
    """Runs by level. ``add`` anti-joins a batch with them and adds the rest as a run of its own."""

    def __init__(self, least_docs: int = LEAST_DOCS, fan: int = FAN) -> None:
        self._least = F.lit(least_docs)
        self._fan = fan
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.unionAll, runs)
        return rows.groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def add(self, lines: DataFrame) -> None:
        """Add a batch of documents whose ids are smaller than those of all batches before it.

        A line that one run alone shows to be repeated is settled: its last document is known, and what
        the batch holds of it need not be added. Of a run only these rows are read.
        """
        fresh = run_of(lines)
        for run in self.runs():
            settled = run.where(F.col("docs") >= self._least).select(*HASH)
            fresh = fresh.join(settled.hint("merge"), HASH, "left_anti")
        self._put(fresh, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(written(run.sortWithinPartitions(*HASH), f"run-{level}"))
        if len(self.levels[level]) == self._fan:
            folded, self.levels[level] = self.levels[level], []
            self._put(self._merged(folded), level + 1)

    def repeated(self) -> DataFrame:
        """(hash, check, last) of the lines that documents enough hold, over all runs."""
        merged = self._merged(self.runs()).where(F.col("docs") >= self._least)
        return written(merged.select(*HASH, "last"), "repeated")


def _batch(docs: DataFrame, batches: int) -> Column:
    """The batch of a doc_id: 0 for the greatest ids. Equal ids share a batch."""
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares)).first()[0] if shares else None
    return sum([(F.col("doc_id") <= F.lit(cut)).cast("int") for cut in cuts or []], F.lit(0))


def losing(docs: DataFrame, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """(doc_id, text_key, positions) of the documents that lose lines, with the places of these lines.

    Rows of one doc_id and equal texts are one row here. What is joined is written before, so that both
    sides are plain exchanges and a line that very many documents hold is split among tasks.
    """
    lines = written(keyed_lines(docs).withColumn("batch", _batch(docs, batches)), "lines", "batch")
    runs = SortedRuns(fan=fan)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    dropped = lines.join(runs.repeated(), HASH).where("doc_id < last")
    places = dropped.groupBy("doc_id", "text_key").agg(F.collect_set("position").alias("positions"))
    return written(places, "losing")


def _place() -> Column:
    return F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(1 << _MAP_BITS))


def _judged(docs: DataFrame, batches: int, fan: int) -> DataFrame:
    """Rows (given, doc_id, kept, n_lines, n_dropped): ``kept`` is the text that stays, null where nothing
    is dropped. ``given`` holds all columns of the documents, whatever their names.

    A bitmap of the ids that lose lines, of at most 2**19 words of 64 bits, is broadcast: only
    documents marked in it are shuffled with their text.
    """
    lost = losing(docs, batches, fan)
    bits = lost.select(_place().alias("place")).select(
        F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63L as int))").alias("bit")
    )
    bitmap = written(bits.groupBy("word").agg(F.bit_or("bit").alias("bits")), "bitmap")
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("given"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key().alias("text_key"),
        _lines(F.col("text")).alias("lines"),
    )
    # A null id is in no word of the bitmap.
    marked = (
        rows.withColumn("place", F.when(F.col("doc_id").isNotNull(), _place()))
        .withColumn("word", F.shiftright("place", 6))
        .join(F.broadcast(bitmap), "word", "left")
        .withColumn("marked", F.coalesce(F.expr("(shiftright(bits, cast(place & 63L as int)) & 1L) = 1L"), F.lit(False)))
        .select("given", "doc_id", "text_key", "lines", "marked")
    )
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    stays = F.array_except(places, F.col("positions"))
    text = F.array_join(F.transform(stays, lambda place: F.get("lines", place)), "\n")
    cut = (
        marked.where("marked")
        .join(lost.hint("merge"), ["doc_id", "text_key"], "left")
        .select(
            "given",
            "doc_id",
            F.when(F.col("positions").isNotNull(), text).alias("kept"),
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )
    whole = marked.where("not marked").select(
        "given",
        "doc_id",
        F.lit(None).cast("string").alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.lit(0).cast("long").alias("n_dropped"),
    )
    return cut.unionAll(whole)


def digests(docs: DataFrame, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document (see ``without_repeated_lines``)."""
    kept = F.coalesce(F.col("kept"), F.col("given.text").cast("string"), F.lit(""))
    return _judged(docs, batches, fan).select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """The documents with repeated lines cut out of ``text``, in the columns given.

    A line is cut if its key has ``LEAST_CHARS`` code points or more, ``LEAST_DOCS`` documents or more hold
    the key and this document is not the one of greatest doc_id among them, which keeps all its lines of
    that key. The other lines stay as they are, joined by a line feed.

    Null and empty texts are one empty line. Rows of one doc_id count as one document; what they hold
    of a line, they keep or lose together. A row without an id is left alone and counts for nothing
    elsewhere. Texts that lose nothing are unchanged, bytes that are no UTF-8 included; in others these are
    replaced. No documents give no rows. Columns may have any names besides ``doc_id`` and ``text``.
    """
    text = F.coalesce(F.col("kept"), F.col("given.text").cast("string"))
    columns = [text.alias(name) if name == "text" else F.col(f"given.`{name}`").alias(name) for name in docs.columns]
    return _judged(docs, batches, fan).select(*columns)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
