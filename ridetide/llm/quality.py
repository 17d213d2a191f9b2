"""Quality classifier: averaged hashed word and character n-gram vectors with a softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridetide.llm.common import id_remainder, ship_package, small_batches, table

SAMPLE = 6_000
"""At most so many labelled documents are learned from, chosen by a hash of their id."""
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
WIDTH = 16
GRAMS = (2, 3, 4)
EPOCHS = 15
RATE = 0.5
THRESHOLD = 0.3


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (values ^ (values >> np.uint64(30))) >> np.uint64(64 - BUCKET_BITS)


def features(raw: bytes) -> np.ndarray:
    """Buckets of a text's words and character n-grams, as often as they occur.

    An n-gram lies in one word with the blanks around it; case and punctuation count.
    """
    words = raw.split()
    if not words:
        return np.empty(0, dtype=np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    codes = np.frombuffer((b" %b " % b" ".join(words)).decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
    blank, codes = codes == 32, codes.astype(np.uint64)
    found = [mixed(hashes)]
    for n in GRAMS:
        count = len(codes) - n + 1
        if count < 1:
            continue
        keys = np.full(count, np.uint64(n))
        inside = np.ones(count, dtype=bool)
        for k in range(n):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + codes[k : count + k]
            if 0 < k < n - 1:
                inside &= ~blank[k : count + k]
        found.append(mixed(keys[inside]))
    return np.concatenate(found).astype(np.int64)


def document_features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    found = features(raw)
    if not len(found):
        return np.empty(0, np.int64), np.empty(0, np.float32)
    counts = np.bincount(found, minlength=BUCKETS).astype(np.float64)
    ids = np.flatnonzero(counts)
    return ids, (counts[ids] / counts.sum()).astype(np.float32)


@dataclass
class Model:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def contribution(self) -> np.ndarray:
        """What each feature adds to the score before the softmax, times the number of features."""
        return self.vectors @ (self.output[:, 1] - self.output[:, 0])


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Stochastic gradient descent, a document at a time, the rate falling to zero."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    output = np.zeros((WIDTH, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    if len(labels):
        share = np.clip(np.bincount(labels, minlength=2) / len(labels), 1e-3, 1)
        bias = np.log(share).astype(np.float32)
    documents = [document_features(text) for text in texts]
    steps, done = epochs * len(documents), 0
    for _ in range(epochs):
        for i in rng.permutation(len(documents)):
            ids, weights = documents[i]
            now = np.float32(rate * (1 - done / steps))
            done += 1
            rows = vectors[ids]
            hidden = weights @ rows if len(ids) else np.zeros(WIDTH, np.float32)
            logits = hidden @ output + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[labels[i]] -= 1
            back = output @ chance
            output -= now * np.outer(hidden, chance)
            bias -= now * np.float32(0.1) * chance
            # The shares sum to one; the step is spread so that a document moves its mean by the rate.
            if len(ids):
                vectors[ids] = rows - np.float32(now) * np.outer(weights / weights.max(), back)
    return Model(vectors, output, bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learn from at most ``sample`` labels (doc_id, label 0 or 1), those of least hash of the id.

    Returns what each bucket adds to the log odds and their value for a text without words. The sample
    is broadcast to the scan of the texts and learned from in one task; both are bounded by ``sample``, as of
    repeated rows of a document the least text is learned from.
    """
    draw = F.xxhash64(F.lit(3), "doc_id")
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = known.select("doc_id", "label", draw.alias("draw")).orderBy("draw", "doc_id", "label").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(
            (draw, label, raw or b"")
            for batch in batches
            for draw, label, raw in zip(*(batch[name].to_pylist() for name in ("draw", "label", "raw")), strict=True)
        )
        model = train([raw for _, _, raw in rows], np.array([label for _, label, _ in rows], dtype=np.int64))
        values = np.append(model.contribution(), model.bias[1] - model.bias[0]).astype("<f8")
        yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], names=["values"])

    # Of rows with one doc_id one text, so that the rows are no more than the labels.
    of_id = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "draw", "label").agg(F.min("raw").alias("raw"))
    given = of_id.select("draw", "label", "raw").repartition(1)
    with small_batches(docs.sparkSession):
        learned = given.mapInArrow(run, "values binary").collect()
    values = np.frombuffer(learned[0]["values"], dtype="<f8") if learned else np.zeros(BUCKETS + 1)
    return values[:-1], float(values[-1])


def score(raw: bytes, values: np.ndarray, base: float) -> float:
    found = features(raw)
    odds = base + (values[found].mean() if len(found) else 0.0)
    return 1 / (1 + float(np.exp(-np.clip(odds, -30, 30))))


def predict(docs: DataFrame, values: np.ndarray, base: float) -> DataFrame:
    """doc_id and score for every row: the chance of label 1. Null text is scored as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(raw or b"", values, base) for raw in batch["raw"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"])

    ship_package(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return given.mapInArrow(run, "doc_id long, score double")


def scored(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_remainder: int = 0) -> DataFrame:
    """Score documents (doc_id, text) for quality, learning from labels (doc_id, quality) not held out.

    Returns doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.3). Held
    out are rows whose crc32 of the id as text leaves ``held_remainder``; a null id is not held out and
    not learned from. Null and empty texts get the score of the share of labels. Without any label all
    scores are 0.5. Labels other than 0 and 1 teach nothing. Repeated rows count as often as they occur.
    Other columns are not read. No documents give no rows.
    """
    held = F.coalesce(id_remainder("doc_id", modulus) == held_remainder, F.lit(False))
    learnable = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")
    ).where(~held)
    values, base = fit(docs, learnable)
    return predict(docs, values, base).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
