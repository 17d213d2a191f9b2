"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridetide.llm.common import id_remainder, read_texts, ship_package, small_batches, table

PROFILE = 400
UNKNOWN = "und"
FLUSH = 4_000_000
FARTHEST = 0.9
"""Documents farther than this from every profile, in parts of the farthest distance, are in none of the languages."""

Profiles = dict[str, list[int]]

BLANK = np.uint64(1)
_WIDTH = np.uint64(21)


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray:
    """The 1-, 2- and 3-grams of a text's lower-cased runs of letters, as often as they occur.

    A run has a blank on either side. An n-gram is one number: its code points, 21 bits each.
    """
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = letters()[codes]
    codes = np.where(letter, codes, BLANK).astype(np.uint64)
    # Only the middle of a trigram must be a letter; a bigram needs one.
    pairs = (codes[:-1] << _WIDTH) | codes[1:]
    triples = (pairs[:-1] << _WIDTH) | codes[2:]
    return np.concatenate([codes[letter], pairs[letter[:-1] | letter[1:]], triples[letter[1:-1]]])


def spelled(gram: int) -> str:
    """The n-gram as text, blanks as spaces."""
    codes = [gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF]
    return "".join(" " if c == 1 else chr(c) for c in codes if c)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts per language, summed in the task before they leave it."""
    found: dict[str, list[np.ndarray]] = {}
    held = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, parts in found.items():
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())],
                names=["lang", "gram", "n"],
            )
        found.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), read_texts(batch["text"]), strict=True):
            own = grams(text)
            found.setdefault(lang, []).append(own)
            held += len(own)
            if held > FLUSH:
                yield from flushed()
                held = 0
    yield from flushed()


def learn(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """The ``size`` most frequent n-grams of each language over all texts, most frequent first.

    ``docs`` has text and lang; rows without either are left out. What comes to the driver are the
    profiles: ``size`` rows for each language.
    """
    given = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).dropna()
    with small_batches(docs.sparkSession):
        total = (
            given.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        )
        order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
        rows = total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).collect()
    profiles: Profiles = {}
    for row in sorted(rows, key=lambda row: (row["lang"], row["rank"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Ranker:
    """Out-of-place distances of texts to all profiles."""

    def __init__(self, profiles: Profiles, size: int):
        self.languages, self.size = sorted(profiles), size
        self.known = np.unique(np.array([g for own in profiles.values() for g in own] or [0], dtype=np.uint64))
        self.places = np.full((len(self.languages), len(self.known)), -1, dtype=np.float64)
        for row, language in enumerate(self.languages):
            self.places[row, np.searchsorted(self.known, np.array(profiles[language], dtype=np.uint64))] = np.arange(
                len(profiles[language])
            )

    def distances(self, found: np.ndarray) -> np.ndarray:
        """To each language, as a part of the farthest possible.

        The ``size`` most frequent n-grams are ranked, equals at the mean of their places. One that a
        profile lacks is as far out of place as can be. ``found`` must not be empty.
        """
        keys, counts = np.unique(found, return_counts=True)
        if len(keys) > self.size:
            least = np.partition(counts, len(counts) - self.size)[len(counts) - self.size]
            keys, counts = keys[counts >= least], counts[counts >= least]
        order = np.lexsort((keys, -counts))[: self.size]
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.r_[True, counts[1:] != counts[:-1]])
        lengths = np.diff(np.r_[starts, len(counts)])
        rank = np.repeat(starts + (lengths - 1) / 2, lengths)
        at = np.searchsorted(self.known, keys).clip(max=len(self.known) - 1)
        place = np.where(self.known[at] == keys, self.places[:, at], -1)
        return np.where(place < 0, self.size, np.abs(place - rank)).sum(axis=1) / (len(keys) * self.size)


def judged(texts: list[str | None], ranker: Ranker) -> tuple[list[str], list[float]]:
    """Language and score of each text.

    The prediction is the language of the least distance, the first by name of equals. The score is one
    less the distance, from 0 (no n-gram in its profile) to 1 (all at their places). Null text, text without
    letters, and any text when there is no profile: ``und``, 0.
    """
    languages, scores = [], []
    for text in texts:
        found = grams(text)
        if len(found) and ranker.languages:
            distances = ranker.distances(found)
            best = int(distances.argmin())
            languages.append(ranker.languages[best])
            scores.append(float(1 - distances[best]))
        else:
            languages.append(UNKNOWN)
            scores.append(0.0)
    return languages, scores


def predict(docs: DataFrame, profiles: Profiles, size: int = PROFILE) -> DataFrame:
    """The rows (text and any others), with lang_pred and score (see ``judged``) in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles, size)
        for batch in batches:
            languages, scores = judged(read_texts(batch["text"]), ranker)
            others = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays(
                [*others.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                names=[*others.schema.names, "lang_pred", "score"],
            )

    ship_package(docs.sparkSession)
    fields = "".join(f"`{name}` {kind}, " for name, kind in docs.dtypes if name != "text")
    return docs.mapInArrow(run, f"{fields}lang_pred string, score double")


def identified(docs: DataFrame, modulus: int = 4, held_remainder: int = 2) -> DataFrame:
    """Predict the language of documents (doc_id, text, lang), learning from those not held out.

    Returns doc_id, held_out, lang_pred and score (see ``predict``). Held out are rows whose crc32 of the
    id as text leaves ``held_remainder``; a null id is not held out. A null lang teaches nothing. Repeated
    rows count as often as they occur. Other columns are not read. No documents give no rows.
    """
    held = F.coalesce(id_remainder("doc_id", modulus) == held_remainder, F.lit(False))
    profiles = learn(docs.where(~held).select("text", "lang"))
    rows = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), profiles)
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def in_known_language(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """The documents whose language can be told, in the columns given: rejected are ``und`` and what is
    far from every profile.

    Null and empty texts, and texts without a letter, are rejected; with no ``lang`` to learn from, all are. Rows
    are judged one by one, repeated ones and those without an id too, and kept with all their columns, whatever
    their names. Bytes that are no UTF-8 are read as replacement characters and kept as they are. No documents give
    no rows."""
    profiles = learn(docs.select("text", "lang"), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles, size)
        for batch in batches:
            languages, scores = judged(read_texts(batch["text"]), ranker)
            known = [lang != UNKNOWN and score >= 1 - FARTHEST for lang, score in zip(languages, scores, strict=True)]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
