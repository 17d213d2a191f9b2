"""Substring dedup: recurring passages confirmed by sampled phrases and located by Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridetide.llm.common import fresh, id_bitmap, sifted, small_batches, table, text_key, written

WINDOW = 50
PHRASE = 10
"""Words of a sampled phrase. Every window holds WINDOW - PHRASE + 1 of them and samples the least hash."""

BLOCK_WORDS = 500_000
"""Words of the documents, on average, that are streamed through one automaton: it holds about a twentieth as many phrases."""
CODE_POINTS = 0x10FFFF
"""Words of phrases are code points to an automaton. Beyond this many, words share one: it then finds too many places."""

PHRASE_ROW, COPY_ROW, DOCUMENT_ROW = range(3)

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Rolling:
    """Hashes of all runs of ``width`` words, by prefix sums modulo 2**64."""

    def __init__(self, base: int):
        self.base = np.uint64(base)
        self.back = np.uint64(pow(base, -1, 1 << 64))
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def __call__(self, hashes: np.ndarray, width: int) -> np.ndarray:
        n = len(hashes)
        if n < width:
            return np.empty(0, dtype=np.uint64)
        if n > len(self.powers):
            self.powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(2 * n, self.base)])
            self.inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(2 * n, self.back)])
        sums = np.r_[np.uint64(0), np.cumsum(hashes * self.powers[:n], dtype=np.uint64)]
        mixed = (sums[width:] - sums[:-width]) * self.inverse[: n - width + 1]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(32))


_ROLLING = tuple(Rolling(base) for base in _BASES)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def sampled(phrases: np.ndarray, span: int) -> np.ndarray:
    """Places of the least hash of every ``span`` neighbours, a hash once: equal windows sample equal phrases."""
    if len(phrases) < span:
        return np.empty(0, dtype=np.int64)
    least = np.lib.stride_tricks.sliding_window_view(phrases, span).argmin(axis=1)
    places = np.unique(least + np.arange(len(least)))
    return places[np.unique(phrases[places], return_index=True)[1]]


def lists(parts: Sequence[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def summarise(window: int, phrase: int):
    """Per document: number of words, hash of the words, sampled phrases as hashes and as words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, hashed, worded = [], [], [], []
            for raw in batch["raw"].to_pylist():
                words = (raw or b"").split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                short = len(words) < window
                hashes = np.empty(0, np.uint64) if short else _ROLLING[0](word_hashes(words), phrase)
                places = sampled(hashes, window - phrase + 1)
                hashed.append(hashes[places].view(np.int64))
                worded.append([b" ".join(words[at : at + phrase]) for at in places.tolist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["text_key"],
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.string()),
                    lists(hashed, pa.int64()),
                    pa.array(worded, pa.list_(pa.binary())),
                ],
                names=["doc_id", "text_key", "n_words", "words_sha256", "phrases", "phrase_words"],
            )

    return run


class Shard:
    """An Aho-Corasick automaton of some recurring phrases; each word of a phrase is one code point to it."""

    def __init__(self, phrases: Iterable[bytes], phrase: int):
        self.phrase = phrase
        self.letters: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for text in phrases:
            letters = [self.letters.setdefault(w, chr(1 + len(self.letters) % CODE_POINTS)) for w in text.split()]
            self.automaton.add_word("".join(letters), 1)
        if self.letters:
            self.automaton.make_automaton()

    def occurrences(self, words: list[bytes]) -> np.ndarray:
        """Where a phrase of the shard starts. Words that are in no phrase share the letter 0."""
        if not self.letters:
            return np.empty(0, dtype=np.int64)
        get = self.letters.get
        stream = "".join([get(word, "\0") for word in words])
        return np.array([end for end, _ in self.automaton.iter(stream)], dtype=np.int64) - (self.phrase - 1)


def locate(window: int, phrase: int):
    """Per document: the windows that hold a recurring phrase, as starts and 128-bit hashes.

    Rows come by block: its phrases, its copies, its documents. The phrases are compiled when the first other
    row of the block comes; then each document of the block is streamed through the automaton.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: int | None = None
        phrases: list[bytes] = []
        copies: set[tuple[int, int]] = set()
        shard: Shard | None = None
        for batch in batches:
            found = []
            columns = (batch[name].to_pylist() for name in ("block", "kind", "doc_id", "text_key", "raw"))
            for number, kind, doc_id, key, raw in zip(*columns, strict=True):
                if number != block:
                    block, phrases, copies, shard = number, [], set(), None
                if kind == PHRASE_ROW:
                    phrases.append(raw)
                    continue
                if kind == COPY_ROW:
                    copies.add((doc_id, key))
                    continue
                if shard is None:
                    shard, phrases = Shard(phrases, phrase), []
                if raw is None or (doc_id, key) in copies:
                    continue
                words = raw.split()
                windows = len(words) - window + 1
                places = shard.occurrences(words) if windows > 0 else ()
                if not len(places):
                    continue
                edge = np.zeros(windows + 1, dtype=np.int64)
                np.add.at(edge, np.clip(places + phrase - window, 0, windows), 1)
                np.add.at(edge, np.clip(places + 1, 0, windows), -1)
                here = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                hashes = word_hashes(words)
                sums = (_ROLLING[n](hashes, window)[here].view(np.int64) for n in range(2))
                found.append((doc_id, key, here.astype(np.int32), *sums))
            doc_ids, keys, starts, first, second = zip(*found, strict=True) if found else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(keys, pa.int64()),
                    lists(starts, pa.int32()),
                    lists(first, pa.int64()),
                    lists(second, pa.int64()),
                ],
                names=["doc_id", "text_key", "starts", "first", "second"],
            )

    return run


def cut_out(window: int):
    """Per document: the removed word spans, the kept words' checksum and the kept text.

    Text between kept words stays as it is; a removed span leaves one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, starts in zip(batch["raw"].to_pylist(), batch["starts"].to_pylist(), strict=True):
                words = raw.split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, np.array(starts) + window, -1)
                gone = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
                turns = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2).tolist()
                parts, kept, at, word = [], [], 0, 0
                for low, high in [*turns, [len(words), len(words)]]:
                    begin = at
                    for piece in words[word:low]:
                        at = raw.index(piece, at) + len(piece)
                    if low > word:
                        kept.extend(words[word:low])
                        parts.append(raw[begin:at].strip() if parts or word else raw[begin:at])
                    for piece in words[low:high]:
                        at = raw.index(piece, at) + len(piece)
                    word = high
                rows.append(
                    (
                        [{"start": low, "end": high} for low, high in turns],
                        int(gone.sum()),
                        hashlib.sha256(b" ".join(kept)).hexdigest(),
                        b" ".join(parts).decode("utf-8", "replace"),
                    )
                )
            spans, removed, digests, texts = zip(*rows, strict=True) if rows else ((), (), (), ())
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["text_key"],
                    pa.array(spans, span),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(texts, pa.string()),
                ],
                names=["doc_id", "text_key", "spans", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def find(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> tuple[DataFrame, DataFrame]:
    """Find the words that repeat a window of a document with a smaller doc_id.

    Returns two tables. One row per document: doc_id, text_key, n_words, words_sha256. One row per
    document that loses words, by (doc_id, text_key): spans of removed words, n_removed, kept_sha256 and
    kept_text.

    1. Each window samples the phrase of least hash in it, so equal windows sample equal phrases; a
       phrase recurs if it is sampled in documents of different ids. Documents whose words are all equal
       to a smaller one's are copies and lose every word.
    2. Documents are dealt in blocks. The recurring phrases that a block's documents sampled are a shard of the
       phrase table, compiled to one automaton, and every document of the block but the copies is streamed
       through it. It finds all phrases that can matter there: a window that recurs samples one of them.
    3. The windows around these places are compared by 128-bit hash; the smallest doc_id keeps one.
    What is counted is written before it is joined: the joins then read two plain exchanges, and a text,
    phrase or window that a third of all documents hold is split among tasks.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = given.select("doc_id", text_key().alias("text_key"), F.col("text").cast("binary").alias("raw"))
    id_columns = "doc_id long, text_key long"
    with small_batches(spark):
        summary = written(
            raw.mapInArrow(
                summarise(window, phrase),
                f"{id_columns}, n_words long, words_sha256 string, phrases array<long>, phrase_words array<binary>",
            ),
            "summary",
        )
        judged = summary.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
        repeated = written(
            judged.groupBy("words_sha256")
            .agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
            .where("first_id < last_id"),
            "repeated",
        )
        copies = written(
            judged.join(repeated, "words_sha256").where("doc_id > first_id").select("doc_id", "text_key", "n_words"),
            "copies",
        ).distinct()
        sampled_by = judged.join(copies, ["doc_id", "text_key"], "left_anti").select(
            "doc_id", "text_key", F.explode(F.arrays_zip("phrases", "phrase_words")).alias("p")
        )
        phrases = sampled_by.select("doc_id", "text_key", F.col("p.phrases").alias("phrase"))
        recurring = written(
            phrases.groupBy("phrase")
            .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
            .where("low < high")
            .select("phrase"),
            "recurring",
        )
        blocks = 1 + (summary.agg(F.sum("n_words")).first()[0] or 0) // BLOCK_WORDS
        block = F.pmod(F.xxhash64(F.lit(13), "doc_id", "text_key"), F.lit(blocks)).alias("block")

        def rows(df: DataFrame, kind: int, doc_id: Column, key: Column, content: Column) -> DataFrame:
            return df.select(
                "block", F.lit(kind).alias("kind"), doc_id.alias("doc_id"), key.alias("text_key"), content.alias("raw")
            )

        none = F.lit(None).cast("long")
        shards = written(
            sampled_by.select(block, F.col("p.phrases").alias("phrase"), F.col("p.phrase_words").alias("words"))
            .join(recurring, "phrase")
            .select("block", "words")
            .distinct(),
            "shards",
        )
        own_id, own_key = F.col("doc_id"), F.col("text_key")
        streamed = (
            rows(shards, PHRASE_ROW, none, none, F.col("words"))
            .unionAll(rows(copies.select("*", block), COPY_ROW, own_id, own_key, F.lit(None).cast("binary")))
            .unionAll(rows(raw.where("doc_id IS NOT NULL").select("*", block), DOCUMENT_ROW, own_id, own_key, F.col("raw")))
            .repartition("block")
            .sortWithinPartitions("block", "kind")
        )
        located = written(
            streamed.mapInArrow(
                locate(window, phrase), f"{id_columns}, starts array<int>, first array<long>, second array<long>"
            ),
            "located",
        )
        windows = located.select(
            "doc_id", "text_key", F.explode(F.arrays_zip("starts", "first", "second")).alias("w")
        ).select("doc_id", "text_key", "w.starts", "w.first", "w.second")
        owners = written(
            windows.groupBy("first", "second")
            .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
            .where("low < high")
            .select("first", "second", "low"),
            "owners",
        )
        covered = written(
            windows.join(owners, ["first", "second"])
            .where("doc_id > low")
            .groupBy("doc_id", "text_key")
            .agg(F.collect_set("starts").alias("starts")),
            "covered",
        )
        removed = written(
            sifted(raw, id_bitmap(covered), True)
            .join(covered, ["doc_id", "text_key"])
            .mapInArrow(
                cut_out(window),
                f"{id_columns}, spans array<struct<start int, end int>>, n_removed long, kept_sha256 string,"
                " kept_text string",
            ),
            "removed",
        )
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    cut = removed.dropDuplicates(["doc_id", "text_key"]).unionByName(
        copies.select(
            "doc_id",
            "text_key",
            whole.alias("spans"),
            F.col("n_words").alias("n_removed"),
            F.lit(EMPTY_SHA).alias("kept_sha256"),
            F.lit("").alias("kept_text"),
        )
    )
    return summary.drop("phrases", "phrase_words"), cut


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document (see ``find``).

    Null and empty texts have no words. A document without an id is left alone and removes nothing
    elsewhere; rows of one doc_id never remove words from each other. Other columns are not read. No
    documents give no rows.
    """
    summary, cut = find(docs, window)
    loss = cut.select("doc_id", "text_key", "n_removed", "kept_sha256")
    return summary.join(loss, ["doc_id", "text_key"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "words_sha256").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated passages cut out of ``text``, in the columns given.

    Documents that lose nothing are unchanged; documents that lose every word are dropped. ``n_chars``,
    where there is one, is counted anew for cut texts, in which bytes that are no UTF-8 are replaced. Columns may
    have any names.
    """
    _, cut = find(docs, window)
    cut_id, cut_key, key, kept = fresh(docs, "__cut_id", "__cut_key", "__key", "__kept")
    loss = cut.select(F.col("doc_id").alias(cut_id), F.col("text_key").alias(cut_key), F.col("kept_text").alias(kept))
    bitmap = id_bitmap(cut)
    given = sifted(docs, bitmap, True).withColumn(key, text_key())
    same = (given["doc_id"] == loss[cut_id]) & (given[key] == loss[cut_key])
    joined = given.join(loss, same, "left")
    left_over = F.coalesce(F.col(kept) != "", F.lit(True))
    out = joined.where(left_over).withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        count = F.when(F.col(kept).isNotNull(), F.length(kept)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return sifted(docs, bitmap, False).unionAll(out.select(*[F.col(f"`{name}`") for name in docs.columns]))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
