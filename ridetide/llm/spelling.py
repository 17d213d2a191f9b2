"""Spelling variants: words one edit apart, found by asymmetric q-chunks and grouped under their commonest form."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridetide.llm.common import small_batches, table, written

LEAST_CHARS = 7
LEAST_COUNT = 2
OUTWEIGHS = 10
"""A near word is the form of a word if it occurs so many times as often."""
DAMAGE = 31
"""One in so many (document, word) pairs is misspelt on purpose."""

_LETTERS = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_CHARS)
_HELD_WORDS = 100_000
"""A task passes its counts on when it holds so many words: this bounds its memory, not the result."""


def misspelt(doc_id: object, words: Counter) -> Iterator[tuple[str, int]]:
    """The words of a document, some of them without one of their letters."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in words.items():
        mark = zlib.crc32(word.encode(), seed)
        if mark % DAMAGE == 0:
            at = mark % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def table_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
        )

    held: Counter = Counter()
    for batch in batches:
        for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["raw"].to_pylist(), strict=True):
            # Of bytes, lower() changes A-Z alone.
            text = (raw or b"").lower().decode("utf-8", "replace")
            for word, n in misspelt(doc_id, Counter(_LETTERS.findall(text))):
                if len(word) >= LEAST_CHARS:
                    held[word] += n
            if len(held) >= _HELD_WORDS:
                yield table_of(held)
                held.clear()
    yield table_of(held)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n, length): words of ``LEAST_CHARS`` code points or more that occur ``LEAST_COUNT`` times or more.

    Each task counts before the shuffle, so a word of all documents is a few rows there.
    """
    raw = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    with small_batches(docs.sparkSession):
        counts = raw.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        return written(
            counts.where(F.col("n") >= LEAST_COUNT).withColumn("length", F.char_length("word")), "vocabulary"
        )


def _cuts(length: Column) -> list[Column]:
    """Where a word of this length is cut: in the middle into its two chunks, and these once more."""
    half = F.floor(length / 2).cast("int")
    return [F.lit(0), F.floor(half / 2).cast("int"), half, half + F.floor((length - half) / 2).cast("int"), length]


def _grams(words: DataFrame, length: Column, role: str) -> DataFrame:
    """A row per place of an edit in a word of ``length`` code points: the hash of what such an edit leaves alone.

    The edit lies in one of the two chunks, so the other one is whole, and it lies in one half of the chunk
    it hits, so the other half is whole: what is before the hit quarter stands at the same place in both
    words, what is after it at the same place or shifted by one, which is the same distance from the end.
    """
    cuts = _cuts(length)
    word = F.col("word")

    def gram(quarter: int) -> Column:
        before, after = cuts[quarter], length - cuts[quarter + 1]
        ending = F.substring(word, F.char_length(word) - after + 1, after)
        return F.xxhash64(length, F.lit(quarter), F.substring(word, F.lit(1), before), ending)

    grams = F.array(*[gram(quarter) for quarter in range(4)])
    return words.select(F.explode(grams).alias("gram"), word.alias(role), F.col("n").alias(f"n_{role}"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words exactly one inserted, deleted or replaced code point apart, once.

    ``a`` is the shorter word, the smaller of equally long ones. It contributes its chunks; the other one
    contributes the grams that a chunk of a word as long or one shorter can meet within a shift of one. Hash
    join on the grams, then the distance itself. The join reads two plain exchanges, so a gram that very many
    words share is split among tasks.
    """
    chunks = _grams(words, F.col("length"), "a")
    grams = _grams(words, F.col("length"), "b").unionAll(
        _grams(words.where(F.col("length") > LEAST_CHARS), F.col("length") - 1, "b")
    )
    ordered = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    one_edit = F.levenshtein("a", "b", 1) == 1
    found = chunks.join(grams.hint("merge"), "gram").where(ordered & one_edit)
    return written(found.select("a", "n_a", "b", "n_b").distinct(), "near")


def forms(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n): near words counted, and the commonest of them, if it outweighs the word."""
    pairs = near_pairs(words)
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionAll(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n"))
    )
    # The least of (-n, word) is the greatest n and, of these, the smallest word.
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best")
    )
    outweighed = -F.col("best.n") >= OUTWEIGHS * F.col("n")
    return words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(outweighed, F.col("best.other")).alias("form"),
        F.when(outweighed, -F.col("best.n")).alias("form_n"),
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form): the end of the forms that follow on each other.

    Each form outweighs its word, so there are no circles and a path of k links takes about log2(k) rounds.
    """
    ends = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(ends.join(onward, "root", "left").select("word", "root", "further"), "roots")
        ends = moved.select("word", F.coalesce("further", "root").alias("root"))
        if moved.where("further is not null").isEmpty():
            return ends


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents (doc_id, text).

    A null text has no words, and a null doc_id counts as empty where words are misspelt by document. Rows
    that are repeated count as often as they occur. Bytes that are no UTF-8 end a word. A tie between
    near words of equal n goes to the smaller one in code-point order. Other columns are not read. No documents
    give no rows.
    """
    judged = written(forms(vocabulary(docs)), "forms")
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
