from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridetide.llm import mixing
from ridetide.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict) -> dict:
    """Budget by weight, the excess reshared among those that are below, round by round."""
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    budget = 1.5 * sum(sizes.values())
    out = {k: budget * weight[k] / sum(weight.values()) for k in names}
    while excess := sum(max(0, out[k] - 2 * sizes[k]) for k in names):
        low = [k for k in names if out[k] < 2 * sizes[k]]
        out = {k: min(out[k], 2 * sizes[k]) for k in names}
        if excess < 1e-6 or not low:
            break
        for k in low:
            out[k] += excess * weight[k] / sum(weight[j] for j in low)
    return out


def check(docs, rows, near):
    given = docs.collect()
    sizes, taken, wanted = defaultdict(int), defaultdict(int), {}
    source = {r["doc_id"]: r["source"] for r in given}
    for r in given:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    for r in rows:
        k = source[r["doc_id"]]
        assert r["source_size"] == sizes[k] and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[k] += r["taken"]
        wanted[k] = r["target"]
    for k, target in targets(dict(sizes)).items():
        assert wanted[k] == pytest.approx(target)
        assert abs(taken[k] - target) <= near


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    check(docs, rows, 1)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (i % 7), f"s{i % 4}" if i % 4 else None, 1, "x") for i in range(400)]
        + [(900, None, "s1", 1, "x"), (901, "", "z", 1, "x")],
        "doc_id long, text string, source string, size int, target string",
    )
    rows = mixing.mix(docs).collect()
    assert len(rows) == 402
    check(docs, rows, 1)
    assert mixing.mix(docs.where(F.lit(False))).count() == 0
    twice = mixing.mix(docs.union(docs)).collect()
    assert len(twice) == 804

    wide = docs.withColumns({"times": F.lit("t"), "text_key": F.lit(1), "taken": F.lit(2)})
    out = mixing.mixed(wide)
    assert out.columns == wide.columns
    amount = Counter()
    for r in rows:
        if r["size"]:
            amount[r["doc_id"]] += r["taken"] // r["size"]
    assert Counter(r["doc_id"] for r in out.collect()) == +amount
    assert sum(r["taken"] // max(1, r["size"]) for r in twice) == mixing.mixed(wide.union(wide)).count()


def test_hot_source(spark):
    """One source of equal documents holds two thirds of all rows."""
    docs = spark.range(9000).select(
        F.col("id").alias("doc_id"),
        F.lit("a b c d e").alias("text"),
        F.when(F.col("id") % 3 < 2, F.lit("b")).otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("source"),
    )
    check(docs, mixing.mix(docs).collect(), 3)


@pytest.mark.parametrize("seed", range(6))
def test_fit_is_nearest(seed):
    """Small cases against every choice."""
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(1, 60), 5, replace=False))
    counts = rng.integers(1, 4, 5)
    sums = {int(np.dot(pick, sizes)) for pick in itertools.product(*(range(c + 1) for c in counts))}
    for budget in rng.integers(0, int(sizes @ counts) + 5, 20):
        take = mixing.fit(int(budget), sizes, counts)
        assert (take >= 0).all() and (take <= counts).all()
        reached = int(take @ sizes)
        assert abs(reached - budget) == min(abs(s - budget) for s in sums)


def test_few_long_documents_are_fitted():
    sizes, counts = np.array([60_000, 70_000, 100_000]), np.ones(3, dtype=np.int64)
    assert mixing.fit(160_000, sizes, counts).tolist() == [1, 0, 1]


@pytest.mark.parametrize("scale", [40_000, 30_000_000_000])
def test_fit_is_nearest_at_any_length(scale):
    """By the table and by the list of sums, against every choice."""
    rng = np.random.default_rng(3)
    for _ in range(10):
        sizes = np.sort(rng.choice(np.arange(1, 60 * scale, 7), 6, replace=False) if scale < 1e6 else rng.integers(1, 60 * scale, 6))
        counts = rng.integers(1, 4, 6)
        sums = {int(np.dot(pick, sizes)) for pick in itertools.product(*(range(c + 1) for c in counts))}
        budget = int(rng.integers(1, int(sizes @ counts)))
        take = mixing.fit(budget, sizes, counts)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int(take @ sizes) - budget) == min(abs(s - budget) for s in sums)


def test_fit_gives_documents_back(monkeypatch):
    """Where neither the table nor the list can be held whole."""
    monkeypatch.setattr(mixing, "TABLE_BITS", 1 << 28)
    monkeypatch.setattr(mixing, "MOST_SUMS", 1 << 10)
    rng = np.random.default_rng(5)
    sizes = np.sort(rng.choice(np.arange(51_000, 90_000), 60, replace=False))
    counts = rng.integers(1, 4, 60)
    for budget in rng.integers(3_000_000, int(sizes @ counts) - 500_000, 5):
        take = mixing.fit(int(budget), sizes, counts)
        assert (take >= 0).all() and (take <= counts).all() and take @ sizes == budget
