from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridetide.llm import flatgraph
from ridetide.llm.common import table


def brute(rows, least=0.93):
    """vec_id -> (n_links, component_id, kept) by comparing all pairs of a label."""
    links, parent = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for label in {r[2] for r in rows if r[2] is not None}:
        own = [(i, np.array(v, dtype=float)) for i, v, k in rows if k == label and v is not None and len(v) and None not in v]
        own = [(i, v) for i, v in own if np.isfinite(v).all() and v.any()]
        for n in {len(v) for _, v in own}:
            ids = [i for i, v in own if len(v) == n]
            m = np.array([v for _, v in own if len(v) == n])
            norm = np.sqrt((m * m).sum(axis=1))
            near = (m @ m.T) / np.outer(norm, norm) >= least
            np.fill_diagonal(near, False)
            for a, b in zip(*np.nonzero(near)):
                links[ids[a]] += 1
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    return {i: (links[i], find(i), find(i) == i) for i in links}


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_whole_table_with_noisy_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    for _ in range(600):
        _, vector, label = rows[int(rng.integers(60)) if rng.random() < 0.5 else int(rng.integers(2000))]
        noise = rng.choice([0, 0.02, 0.045]) * rng.standard_normal(len(vector))
        rows.append((len(rows), (np.array(vector) + noise).tolist(), label))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    wanted = brute(rows)
    assert sum(n for n, _, _ in wanted.values()) > 1000
    assert result(flatgraph.near_duplicates(frame)) == wanted


def test_many_shards(spark, monkeypatch):
    """Families across small shards: links are counted once, and found across shards too."""
    monkeypatch.setattr(flatgraph, "SHARD", 120)
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(40):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 40))):
            rows.append((len(rows), (base + rng.uniform(0, 0.35) * rng.standard_normal(16)).tolist(), 1))
    rows += [(len(rows) + k, rows[5][1], 1) for k in range(30)]
    # Shorter vectors of the same label: a place of their own, which is split too.
    rows += [(len(rows) + k, rng.standard_normal(5).tolist(), 1) for k in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    wanted, got = brute(rows), result(flatgraph.near_duplicates(frame))
    found = sum(n for n, _, _ in got.values())
    there = sum(n for n, _, _ in wanted.values())
    assert 0.99 * there <= found <= there
    assert all(got[i][0] <= wanted[i][0] for i in wanted)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(9, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0] * 3, 1),
            (8, [1.0, None, 3.0], 1), (10, [float("nan")] * 3, 1), (11, [float("inf"), 2.0, 3.0], 1), (12, [], 1), (13, [1.0, 2.0], 1), (14, [-1.0, -2.0, -3.0], 1)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows] + [(None, v, 1, 1, "x")], "vec_id long, embedding array<double>, label int, node int, copies string")
    got = result(flatgraph.near_duplicates(frame))
    assert got.pop(None) == (0, None, True)
    assert got == {**{i: (0, i, True) for i in range(2, 15) if i in {r[0] for r in rows}}, 2: (2, 2, True), 3: (2, 2, False), 9: (2, 2, False)}
    assert flatgraph.near_duplicates(frame.where(F.lit(False))).count() == 0
    twice = flatgraph.near_duplicates(frame.where("vec_id in (2, 4)").unionAll(frame.where("vec_id = 2"))).collect()
    assert sorted(tuple(r) for r in twice) == [(2, 1, 2, True), (2, 1, 2, True), (4, 0, 4, True)]


def test_prune_and_search_on_a_line():
    angles = np.linspace(0, 3, 200)
    vectors = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    neighbours = flatgraph.robust_prune((vectors @ vectors.T).astype(np.float32), degree=4, pool=20)
    rows, columns = np.nonzero(neighbours >= 0)
    to = neighbours[rows, columns]
    graph = flatgraph.ShardGraph(vectors, np.r_[rows, to], np.r_[to, rows])
    queries, nodes, cosines = graph.range_search(0.93, 8)
    wanted = (vectors @ vectors.T >= 0.93).sum()
    assert len(queries) == pytest.approx(wanted, rel=0.001) and cosines.min() >= 0.93 - 1e-9


def three_clumps():
    """Tighter inside than between, all of them linked; the medoid is in one of them."""
    rng = np.random.default_rng(8)
    turn = 2 * np.pi * np.arange(3) / 3
    middles = np.zeros((3, 64))
    middles[:, 0], middles[:, 1], middles[:, 2] = 1, 0.15 * np.cos(turn), 0.15 * np.sin(turn)
    noise = np.pad(rng.standard_normal((450, 61)), ((0, 0), (3, 0)))
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    return np.repeat(middles, 150, axis=0) + 0.1 * noise


def test_graph_leaves_dense_clumps():
    vectors = three_clumps()
    edges = flatgraph.built()(pa.table({"node": np.arange(450), "vector": vectors.tolist()}))
    graph = flatgraph.ShardGraph(vectors, edges["node"].to_numpy(), edges["neighbour"].to_numpy())
    queries, _, cosines = graph.range_search(0.93)
    assert len(queries) == 450 * 450 and cosines.min() >= 0.93


def test_dense_clumps_and_exact_comparison(spark, monkeypatch):
    vectors = three_clumps().tolist()
    rng = np.random.default_rng(9)
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(500 + i, v, 1) for i, v in enumerate(vectors[:5])]
    rows += [(600 + i, rng.standard_normal(64).tolist(), 1 + i % 2) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    wanted = brute(rows)
    assert result(flatgraph.near_duplicates(frame)) == wanted
    # Where no graph is good enough, everything is compared.
    monkeypatch.setattr(flatgraph, "SHARD", 120)
    monkeypatch.setattr(flatgraph, "ATTEMPTS", 1)
    monkeypatch.setattr(flatgraph, "RECALL", 2.0)
    monkeypatch.setattr(flatgraph, "graph_links", lambda classes, *_: (classes.selectExpr("node", "0L AS links"), None))
    assert result(flatgraph.near_duplicates(frame)) == wanted


def test_audit_looks_at_classes_with_links(spark):
    """One linked pair of three among many classes without links."""
    rng = np.random.default_rng(10)
    vectors = [*rng.standard_normal((3000, 16)), *(np.ones(16) + 0.01 * rng.standard_normal((3, 16)))]
    rows = [(i, 1, v.tolist(), 1) for i, v in enumerate(vectors)]
    classes = spark.createDataFrame(rows, "node long, place long, vector array<double>, copies long")
    links = spark.createDataFrame([(3000, 1), (3001, 1)], "node long, links long")
    assert flatgraph.audited(classes, links, 0.93, 20) == 0.5


def test_audit_counts_classes_not_copies(spark):
    """Of 60 linked pairs only one, with a million copies, is found; the graph has an edge for the others."""
    rng = np.random.default_rng(12)
    middles = rng.standard_normal((60, 32))
    vectors = np.repeat(middles, 2, axis=0) + 0.01 * rng.standard_normal((120, 32))
    others = rng.standard_normal((1500, 32))
    rows = [(i, 1, v.tolist(), 1_000_000 if i < 2 else 1) for i, v in enumerate([*vectors, *others])]
    classes = spark.createDataFrame(rows, "node long, place long, vector array<double>, copies long")
    found = [(0, 1_000_000, 1.0), (1, 1_000_000, 1.0), *((i, 0, 0.99) for i in range(2, 120))]
    links = spark.createDataFrame(found, "node long, links long, nearest double")
    assert flatgraph.audited(classes, links, 0.93) < 0.1


def test_dense_cluster_over_many_shards_in_bounded_memory(spark, monkeypatch):
    """Every vector links every other one, in shards of a seventh of them: nothing is listed pair by pair."""
    monkeypatch.setattr(flatgraph, "SHARD", 60)
    rng = np.random.default_rng(14)
    middle = rng.standard_normal(32)
    rows = [(i, (middle + 0.1 * rng.standard_normal(32)).tolist(), 1) for i in range(420)]
    rows += [(1000 + i, rng.standard_normal(32).tolist(), 1) for i in range(100)] + [(2000, rows[3][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert result(flatgraph.near_duplicates(frame)) == brute(rows)


def test_search_of_a_dense_shard_is_bounded():
    """900 vectors, all linked, with edges to 900 outside: what is held and told follows the vectors, not the pairs."""
    rng = np.random.default_rng(15)
    n, vectors = 900, rng.standard_normal(64) + 0.1 * rng.standard_normal((1800, 64))
    direction = flatgraph.unit(vectors)
    similar = (direction @ direction.T).astype(np.float32)
    to = np.argsort(rng.random((n, 2 * n)), axis=1)[:, :80]
    edges = [[{"neighbour": int(k), "cosine": float(similar[i, k])} for k in own if k != i] for i, own in enumerate(to)]
    shard = pa.table(
        {
            "shard": pa.array([7] * n, pa.int64()),
            "node": np.arange(n),
            "copies": np.ones(n, np.int64),
            "vector": vectors[:n].tolist(),
            "shards": pa.array([[7, 9]] * n, pa.list_(pa.int64())),
            "edges": pa.array(edges, pa.list_(pa.struct([("neighbour", pa.int64()), ("cosine", pa.float32())]))),
        }
    )
    tracemalloc.start()
    found = flatgraph.search_shard(0.93, 0.12, 24)(shard)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    told = found.to_pandas()
    assert (told[told.exit == 0].links == n - 1).all() and (told[told.exit == 0].other == 0).all()
    assert found.num_rows <= n + 2 * n and most < 150e6
