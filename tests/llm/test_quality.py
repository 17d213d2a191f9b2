from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridetide.llm import quality
from ridetide.llm.common import table


def test_whole_table_held_out(spark):
    sf = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    rows = quality.op6_quality_classifier(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and label.get(r["doc_id"]) is not None]
    # Plain words and n-grams: 96.6 % when this was written.
    assert sum(r["predicted"] == label[r["doc_id"]] for r in held) >= 0.96 * len(held)


def test_features_by_hand():
    found = quality.features("ab  ab\ncéd ab".encode())
    padded = [" ab ", " ab ", " céd ", " ab "]
    # One blank between words belongs to both, so an n-gram is counted once per word.
    grams = [p[i : i + n] for p in padded for n in quality.GRAMS for i in range(len(p) - n + 1)]
    assert len(found) == 4 + len(grams)
    assert quality.features(b" \n").size == 0


def test_many_rows_of_one_labelled_document_are_one_to_learn_from(spark):
    """Ten thousand copies of a labelled id change nothing."""
    texts = [(n, "good thing here" if n % 2 else "bad thing here") for n in range(40)]
    labels = spark.createDataFrame([(n, n % 2) for n in range(40)], "doc_id long, label int")
    once = spark.createDataFrame(texts, "doc_id long, text string")
    copies = spark.range(10_000).select(F.lit(4).cast("long").alias("doc_id"), F.lit("bad thing here").alias("text"))
    values, base = quality.fit(once, labels)
    again, base_again = quality.fit(once.unionAll(copies), labels)
    assert np.array_equal(values, again) and base == base_again


def test_against_a_plain_averaging(spark):
    """The scores of the query are those of the learned vectors, averaged by hand."""
    texts = [(n, ["good words here", "bad words there", "other", "", None][n % 5]) for n in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(n, int(n % 5 == 0)) for n in range(40)], "doc_id long, quality int")
    known = sorted(
        (row["draw"], row["label"], (dict(texts)[row["doc_id"]] or "").encode())
        for row in labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        .select("doc_id", F.col("quality").alias("label"), F.xxhash64(F.lit(3), "doc_id").alias("draw"))
        .collect()
    )
    model = quality.train([text for _, _, text in known], np.array([label for _, label, _ in known]))
    for row in quality.scored(docs, labels).collect():
        found = quality.features((dict(texts)[row["doc_id"]] or "").encode())
        logits = model.bias + (model.vectors[found].mean(axis=0) @ model.output if len(found) else 0)
        odds = float(logits[1] - logits[0])
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-5)


def test_gradient_learns_a_word():
    texts = [b"good thing here", b"bad thing here"] * 40
    model = quality.train(texts, np.array([1, 0] * 40), epochs=4)
    values, base = model.contribution(), float(model.bias[1] - model.bias[0])
    assert quality.score(b"good thing", values, base) > 0.8 > 0.2 > quality.score(b"bad thing", values, base)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 1, "a"), (2, "", 1, "a"), (3, "good words", 1, "a"), (None, "good", 1, "a"), (3, "good words", 1, "a"), (4, "x " * 90_000, 1, "a")],
        "doc_id long, text string, score int, label string",
    )
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (3, 1, 1), (2, None, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    unlabelled = quality.scored(docs, labels.where(F.lit(False))).collect()
    assert all(r["score"] == pytest.approx(0.5) for r in unlabelled)
    assert quality.scored(docs.where(F.lit(False)), labels).count() == 0
