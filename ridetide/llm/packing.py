"""Packing documents into sequences of a fixed number of tokens by cutting-stock column generation."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridetide.llm import cutting
from ridetide.llm.common import ranked, read_texts, small_batches, table, written

SEQUENCE = 1024
END = 0
TOKENIZER = "byte_bpe_50k"

PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
PIECES = ", ".join(f"{column} long" for column in PIECE_COLUMNS)

# Both libraries cut Latin text at the same places; other scripts depend on the Unicode version that
# a library was built with, and very long texts on how it bounds its work.
LATIN = re.compile(r"[\x00-ɏ‐-‧€]*").fullmatch
LONG_TEXT = 1_000_000
LONG_RUN = re.compile(r"[^\W\d_]{2000}|\d{2000}|\s{2000}|[^\w\s]{2000}").search
HALF = 1000
HALF_RUN = re.compile(r"[^\W\d_]{1000}|\d{1000}|\s{1000}|[^\w\s]{1000}").match


def has_long_run(text: str) -> bool:
    """Whether ``LONG_RUN`` finds a run. One of 2,000 covers a whole block of 1,000 that begins at a multiple of
    1,000, and most blocks end their run after a few letters."""
    return any(HALF_RUN(text, at) for at in range(0, len(text) - HALF + 1, HALF)) and LONG_RUN(text) is not None


class Encoder:
    """Ids of the named vocabulary, as ``tokenizers`` gives them without special tokens added.

    Plain Latin text goes through ``tiktoken`` with the same vocabulary as ranks: equal ids in a
    third of the time. Everything else goes through ``tokenizers`` itself.
    """

    def __init__(self, name: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [token.content for token in self.full.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def ids(self, text: str) -> np.ndarray:
        plain = len(text) < LONG_TEXT and (text.isascii() or LATIN(text)) and not has_long_run(text)
        if plain and not any(token in text for token in self.special):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")


@functools.cache
def encoder(name: str) -> Encoder:
    return Encoder(name)


def pieces(docs: DataFrame, size: int = SEQUENCE, tokenizer: str = TOKENIZER) -> DataFrame:
    """Documents as token pieces: full sequences first, then the rest.

    A document's cuts depend on its own length only, so that ids are made once and not kept.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), read_texts(batch["text"]), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.int64()) for values in zip(*rows, strict=True)], names=PIECE_COLUMNS
            )

    with small_batches(docs.sparkSession):
        return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES), "pieces")


def slots(spark: SparkSession, plan: list[tuple[int, cutting.Pattern]]) -> DataFrame:
    """The plan as rows: which ranks of a length go into which sequences, at which offset.

    One row per pattern and length: bounded by the sequence size, not by the documents.
    """
    rows, used, first = [], {}, 0
    for times, pattern in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            rank = used.get(length, 0)
            used[length] = rank + times * pattern[length]
            rows.append((length, rank, used[length], pattern[length], first, offset))
            offset += length * pattern[length]
        first += times
    return spark.createDataFrame(
        rows, "length long, rank_from long, rank_to long, times long, first_sequence long, first_offset long"
    )


def pack(docs: DataFrame, size: int = SEQUENCE, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``size`` tokens.

    A document is its ids and one end id. One row per piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset. The histogram of piece lengths, at most ``size`` rows, is solved
    on the driver; pieces are ranked within their length and meet the plan by a bounded broadcast.

    Null text is empty text: one piece with the end id. Bytes that are no UTF-8 are replacement characters. Rows with a null or repeated doc_id are
    documents of their own. Other columns are not read. No documents give no rows.
    """
    cut = pieces(docs, size, tokenizer)
    counts = {row["length"]: row["count"] for row in cut.groupBy("length").count().collect()}
    plan = F.broadcast(slots(docs.sparkSession, cutting.plan(counts, size)))
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    numbered = ranked(cut, ["length"], order, "rank", few_groups=True)
    inside = (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    placed = numbered.join(plan, "length").where(inside)
    nth = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.floor(nth / F.col("times"))).alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("times") * F.col("length")).alias("offset"),
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
