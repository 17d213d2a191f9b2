from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridetide.llm import onebit
from ridetide.llm.common import table


def brute(rows, modulus, nearest):
    out = {}
    for query, q in rows:
        if query % modulus == 0:
            scored = sorted((-math.fsum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != query)[:nearest]
            out[query] = [(i, -s) for s, i in scored]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert all([rank for rank, _, _ in own] == list(range(1, len(own) + 1)) for own in out.values())
    return out


def test_recall_on_the_whole_table(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    wanted = brute(rows, 20, 20)
    found = result(onebit.op10_onebit_ann(spark, "/root/testdata/sf0.1"))
    assert set(found) == set(wanted) and all(len(own) == 20 for own in found.values())
    hits = sum(len({i for i, _ in wanted[q]} & {i for _, i, _ in found[q]}) for q in wanted)
    assert hits >= 0.95 * 20 * len(wanted)
    vector = dict(rows)
    for q, own in found.items():
        for _, i, score in own:
            assert score == pytest.approx(math.fsum(a * b for a, b in zip(vector[q], vector[i])), abs=1e-9)


def test_copies_ties_and_few_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 8).astype(float).tolist()) for i in range(1, 300)]
    rows = [(i, v if any(v) else [1.0] * 8) for i, v in rows]
    rows += [(i, [1.0] + [0.0] * 6 + [2.0]) for i in range(300, 500)]
    odd = [(1000, None), (1020, []), (1040, [0.0] * 8), (1060, [float("nan")] * 8), (1080, [None] * 8), (1100, [float("inf")] + [1.0] * 7), (1120, [1.0] * 3), (None, [1.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, score int, block string")
    wanted = brute(rows, 20, 20)
    found = result(onebit.search(frame, F.col("vec_id") % 20 == 0, width=50.0))
    assert {q: [(i, s) for _, i, s in own] for q, own in found.items()} == wanted
    few = frame.where("vec_id <= 5 or vec_id = 20")
    assert [len(own) for own in result(onebit.search(few, F.col("vec_id") % 20 == 0)).values()] == [5]
    assert onebit.search(frame.where(F.lit(False)), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold_as_often_as_they_should():
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((4000, 64))
    queries = rng.standard_normal((50, 64))
    codes = onebit.Codes(vectors, onebit.centres(vectors[:500], 8), onebit.rotation(64))
    estimate, error = codes.bounds(queries, 1.9)
    within = np.abs(estimate - queries @ vectors.T) <= error
    assert 0.92 <= within.mean() <= 0.99
    assert abs((estimate - queries @ vectors.T).mean()) < 0.05
