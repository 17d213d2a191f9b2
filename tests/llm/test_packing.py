from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridetide.llm import cutting
from ridetide.llm.common import table
from ridetide.llm.packing import LONG_RUN, Encoder, has_long_run, pack


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts, plain, size):
    """Every id of every text in exactly one piece; sequences gapless; returns (tokens, padded)."""
    documents = defaultdict(list)
    sequences = defaultdict(list)
    for row in rows:
        documents[row["doc_id"]].append(row)
        sequences[row["sequence_id"]].append(row)
    assert set(documents) == set(texts)
    for doc_id, own in documents.items():
        ids = [*plain.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0]
        at = 0
        for row in sorted(own, key=lambda r: r["start"]):
            assert row["start"] == at and row["doc_tokens"] == len(ids)
            piece = np.array(ids[at : at + row["length"]], dtype="<u4")
            assert zlib.crc32(piece.tobytes()) == row["ids_crc32"]
            at += row["length"]
        assert at == len(ids)
    tokens = total = 0
    for own in sequences.values():
        at = 0
        for row in sorted(own, key=lambda r: r["offset"]):
            assert row["offset"] == at
            at += row["length"]
        assert at <= size
        tokens += at
        total += cutting.padded(at, size)
    return tokens, total


def test_pack_whole_table(spark, plain):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    tokens, total = check(pack(docs).collect(), texts, plain, 1024)
    assert total - tokens < 0.004 * tokens


def test_pack_odd_rows(spark, plain):
    texts = {1: None, 2: "", 3: "x " * 9000, 4: "a", 5: "a", None: "b", 6: "漢字かな <|endoftext|> ١٢٣", 7: "é" * 5000}
    docs = spark.createDataFrame(
        [(k, v, "extra", 7) for k, v in texts.items()], "doc_id long, text string, length string, sequence_id int"
    )
    check(pack(docs, 64).collect(), texts, plain, 64)


def test_pack_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "one two")] * 3, "doc_id long, text string")
    rows = pack(docs).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    assert pack(docs.where(F.lit(False))).count() == 0


def test_fast_ids_equal(plain):
    encoder = Encoder("byte_bpe_50k")
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]]
    common = list("  \n\t'sdtlrvem.0aZé")
    for _ in range(3000):
        text = "".join(rng.choice(letters if rng.random() < 0.5 else common) for _ in range(rng.randrange(60)))
        assert encoder.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_long_runs_are_found_wherever_they_begin():
    rng = random.Random(3)
    found = 0
    for _ in range(400):
        length = rng.choice([999, 1000, 1999, 2000, 2001, 2999, 5000])
        run = rng.choice(["é", "7", " ", "!", "a_", "x1"]) * length
        text = "ab 1! " * rng.randrange(400) + run[:length] + "1 .b" * rng.randrange(400)
        assert has_long_run(text) == (LONG_RUN(text) is not None)
        found += has_long_run(text)
    assert 50 < found < 350 and not has_long_run("") and has_long_run("x" * 2000) and not has_long_run("x" * 1999)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    capacity = 256
    counts = {int(n): int(k) for n, k in zip(rng.choice(256, 60, replace=False) + 1, rng.integers(1, 500, 60))}
    left = dict(counts)
    for times, pattern in cutting.plan(counts, capacity):
        assert sum(n * k for n, k in pattern.items()) <= capacity
        for n, k in pattern.items():
            left[n] -= times * k
    assert not any(left.values())


def test_columns_lower_the_cost():
    """Lengths whose first patterns waste space: generated columns reach the known optimum."""
    counts = {40: 300, 35: 300, 25: 600}
    lengths = np.array(sorted(counts))
    amounts = np.array([counts[int(n)] for n in lengths])
    matrix, fractions = cutting.linear_program(lengths, amounts, 100)
    assert np.allclose(matrix @ fractions, amounts)
    assert fractions.sum() == pytest.approx(amounts @ lengths / 100, rel=0.01)
