"""Embedding near-dedup on a robust-pruned flat graph built over overlapping cluster shards."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridetide.llm.common import small_batches, table, written
from ridetide.llm.graph import components
from ridetide.llm.onebit import centres, matrix
from ridetide.llm.vectors import usable

COSINE = 0.93
OVERLAP = 3
"""Every vector is in the shards of so many nearest centres, at each level of splitting."""
SHARD = 2500
"""Larger groups are split again, so that a shard fits one task."""
SPLIT = 24
SAMPLE = 1024
"""Centres of a group are fitted on at most so many of its vectors."""
DEGREE = 24
POOL = 96
ALPHA = 1.2
BEAM = 24
SLACK = 0.12
"""Nodes down to COSINE - SLACK are expanded too, to cross gaps between near ones."""
PART = 256
"""A shard's nodes are searched and compared so many at a time: what one step holds does not follow the links."""
AUDIT = 200
RECALL = 0.99
ATTEMPTS = 3


def robust_prune(similar: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of every node, -1 where there are fewer: the nearest first, and none that an earlier
    neighbour is ``alpha`` times nearer to than the node is. All nodes are pruned at the same time."""
    n = len(similar)
    pool = min(pool, n - 1)
    if pool < 1:
        return np.full((n, 1), -1)
    masked = similar.copy()
    np.fill_diagonal(masked, -np.inf)
    candidates = np.argpartition(-masked, pool - 1, axis=1)[:, :pool]
    far = 1 - np.take_along_axis(masked, candidates, axis=1)
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    alive = np.ones_like(far, dtype=bool)
    out = np.full((n, degree), -1)
    rows = np.arange(n)
    for k in range(degree):
        any_left = alive.any(axis=1)
        if not any_left.any():
            break
        first = alive.argmax(axis=1)
        chosen = candidates[rows, first]
        out[any_left, k] = chosen[any_left]
        between = 1 - similar[chosen[:, None], candidates]
        alive &= alpha * between > far
        alive[rows, first] = False
    return out


def spanning(similar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a tree of the greatest cosines. Whatever ``pool`` and ``degree`` leave out, nodes that are
    joined by links are joined by links of the tree."""
    n = len(similar)
    value, parent, free = similar[0].copy(), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    value[0], free[0] = -np.inf, False
    added = []
    for _ in range(n - 1):
        node = int(value.argmax())
        added.append(node)
        value[node], free[node] = -np.inf, False
        better = free & (similar[node] > value)
        value[better], parent[better] = similar[node][better], node
    added = np.array(added, dtype=np.int64)
    return added, parent[added]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]


def built(degree: int = DEGREE, pool: int = POOL):
    """One shard's graph: (node, neighbour, cosine)."""

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("node")
        nodes, vectors = shard["node"].to_numpy(), unit(matrix(shard["vector"]))
        similar = (vectors @ vectors.T).astype(np.float32)
        neighbours = robust_prune(similar, degree, pool)
        row, column = np.nonzero(neighbours >= 0)
        # The nearest alone give no way out of a clump of more than the pool.
        out, back = spanning(similar)
        row, to = np.r_[row, out], np.r_[neighbours[row, column], back]
        # Both directions: a greedy search must be able to come back.
        a, b = np.r_[row, to], np.r_[to, row]
        pairs = np.unique(a * len(nodes) + b)
        a, b = pairs // len(nodes), pairs % len(nodes)
        return pa.table({"node": nodes[a], "neighbour": nodes[b], "cosine": similar[a, b]})

    return run


class ShardGraph:
    """The union graph inside one shard, and searches of all its members at the same time."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, neighbours: np.ndarray):
        self.vectors = unit(vectors)
        self.plain = vectors
        order = np.argsort(rows, kind="stable")
        self.to = neighbours[order]
        self.starts = np.searchsorted(rows[order], np.arange(len(vectors) + 1))
        self.matrix: np.ndarray | None = None

    def fan_out(self, queries: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All neighbours of each (query, node)."""
        lengths = self.starts[nodes + 1] - self.starts[nodes]
        total = int(lengths.sum())
        shift = np.repeat(np.cumsum(lengths) - lengths, lengths)
        where = np.arange(total) - shift + np.repeat(self.starts[nodes], lengths)
        return np.repeat(queries, lengths), self.to[where]

    def cosine(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        out = np.empty(len(queries))
        for at in range(0, len(queries), 100_000):
            part = slice(at, at + 100_000)
            out[part] = np.einsum("ij,ij->i", self.vectors[queries[part]], self.vectors[nodes[part]])
        return out

    def adjacent(self) -> np.ndarray:
        """The edges as a matrix."""
        if self.matrix is None:
            n = len(self.vectors)
            self.matrix = np.zeros((n, n), dtype=np.float32)
            self.matrix[np.repeat(np.arange(n), np.diff(self.starts)), self.to] = 1
        return self.matrix

    def fresh(self, met: np.ndarray, visited: np.ndarray) -> np.ndarray:
        """Neighbours of (query, node) keys that were not visited; they are from now on."""
        n = len(self.vectors)
        queries, nodes = met // n, met % n
        if (self.starts[nodes + 1] - self.starts[nodes]).sum() * 4 > n * n:
            # So many edges that a product of matrices is less work, and of bounded size.
            first = int(queries[0])
            mask = np.zeros((int(queries[-1]) - first + 1, n), dtype=np.float32)
            mask[queries - first, nodes] = 1
            keys = first * n + np.flatnonzero(mask @ self.adjacent())
        else:
            queries, found = self.fan_out(queries, nodes)
            keys = np.unique(queries * n + found)
        keys = keys[~visited[keys]]
        visited[keys] = True
        return keys

    def reached(self, least: float, beam: int = BEAM) -> np.ndarray:
        """Which nodes every member reaches from the medoid, as a matrix (query, node).

        Greedy: the best ``beam`` nodes seen are kept and expanded until a query has met itself, the
        nearest there is, or has nothing left to expand. Then its range grows: every node of at least
        ``least`` is expanded, until no new one turns up.
        """
        n = len(self.vectors)
        medoid = int((self.vectors @ self.vectors.mean(axis=0)).argmax())
        seen = np.zeros((n, n), dtype=bool)
        expanded = np.zeros((n, n), dtype=bool)
        everyone = np.arange(n)
        best = np.full((n, beam), -1)
        value = np.full((n, beam), -np.inf)
        best[:, 0], seen[:, medoid] = medoid, True
        value[:, 0] = self.cosine(everyone, np.full(n, medoid))
        for at in range(0, n, PART):
            active = everyone[at : at + PART]
            active = active[active != medoid]
            while len(active):
                own, cosines = best[active], value[active]
                closed = (own < 0) | expanded[active[:, None], np.maximum(own, 0)]
                open_value = np.where(closed, -np.inf, cosines)
                pick = open_value.argmax(axis=1)
                going = open_value[np.arange(len(active)), pick] > -np.inf
                active, nodes = active[going], own[going, pick[going]]
                if not len(active):
                    break
                expanded[active, nodes] = True
                queries, found = self.fan_out(active, nodes)
                new = ~seen[queries, found]
                queries, found = queries[new], found[new]
                seen[queries, found] = True
                cosine = self.cosine(queries, found)
                # Each query's new nodes join its beam; the best stay.
                place = np.searchsorted(active, queries)
                nth = np.arange(len(queries)) - np.searchsorted(queries, queries)
                width = int(nth.max()) + 1 if len(nth) else 1
                more, more_value = np.full((len(active), width), -1), np.full((len(active), width), -np.inf)
                more[place, nth], more_value[place, nth] = found, cosine
                all_nodes = np.concatenate([best[active], more], axis=1)
                all_values = np.concatenate([value[active], more_value], axis=1)
                top = np.argpartition(-all_values, beam - 1, axis=1)[:, :beam]
                best[active] = np.take_along_axis(all_nodes, top, 1)
                value[active] = np.take_along_axis(all_values, top, 1)
                active = active[~seen[active, active]]
        queries, slots = np.nonzero(value >= least)
        met = np.unique(np.r_[queries * n + best[queries, slots], everyone * (n + 1)])
        visited, within = seen.reshape(-1), expanded.reshape(-1)
        visited[:], within[:] = False, False
        visited[met] = True
        while len(met):
            within[met] = True
            ends = np.searchsorted(met, np.arange(PART // 4, n, PART // 4) * n)
            nearer = [np.empty(0, np.int64)]
            for part in np.split(met, ends):
                if len(part):
                    keys = self.fresh(part, visited)
                    nearer.append(keys[self.cosine(keys // n, keys % n) >= least])
            met = np.concatenate(nearer)
        return expanded

    def range_search(self, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, cosine) of what every member reaches."""
        queries, nodes = np.nonzero(self.reached(least, beam))
        return queries, nodes, self.cosine(queries, nodes)


def linked(vectors: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """The exact check: cosine of the original vectors in double precision."""
    out = np.empty(len(a), dtype=bool)
    for at in range(0, len(a), 50_000):
        part = slice(at, at + 50_000)
        x, y = vectors[a[part]], vectors[b[part]]
        norms = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
        out[part] = (x * y).sum(axis=1) / norms >= least
    return out


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The roots when these links are added."""
    a, b = root[a], root[b]
    apart = a != b
    return local_roots(len(root), a[apart], b[apart])[root] if apart.any() else root


def marks(lists: pa.Array, below: int | None = None) -> np.ndarray:
    """The entries of each list, those under ``below`` only, as bits: of entries that several lists have."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, rows = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    if below is not None:
        flat, rows = flat[flat < below], rows[flat < below]
    _, codes, counts = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    several = counts[codes] > 1
    out = np.zeros((len(lists), int((counts > 1).sum())), dtype=bool)
    out[rows[several], number[codes[several]]] = True
    return np.packbits(out, axis=1)


def in_common(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), dtype=bool)
    for at in range(0, len(a), 200_000):
        part = slice(at, at + 200_000)
        out[part] = (bits[a[part]] & bits[b[part]]).any(axis=1)
    return out


def search_shard(least: float, slack: float, beam: int):
    """One shard: links found, as counts of equal vectors, hooks to join components, and who has to meet.

    A pair that meets in several shards is counted in the first of them. Where an edge of the union graph
    leaves the shard near a node that a member has reached, and its angle allows a link, the member and the
    outside node have to meet: (shard, node) each, not a row for every pair of them.
    """

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("node")
        here = shard["shard"][0].as_py()
        nodes, copies, plain = shard["node"].to_numpy(), shard["copies"].to_numpy(), matrix(shard["vector"])
        n = len(nodes)
        edges = shard["edges"].combine_chunks()
        rows = np.repeat(np.arange(n), np.diff(edges.offsets.to_numpy()))
        flat = edges.flatten()
        to, edge_cosine = flat.field("neighbour").to_numpy(), flat.field("cosine").to_numpy().astype(np.float64)
        at = np.searchsorted(nodes, to).clip(max=n - 1)
        inside = nodes[at] == to
        graph = ShardGraph(plain, rows[inside], at[inside])
        reached = graph.reached(least - slack, beam)

        # An edge that leaves the shard can lead to a link only if its angle allows it.
        leaving = np.flatnonzero(~inside)
        order = leaving[np.argsort(rows[leaving], kind="stable")]
        starts = np.searchsorted(rows[order], np.arange(n + 1))
        wide = math.acos(least) + 1e-6
        # In one order of nodes, and of angles at a node.
        low = lambda node, angle: node * 4.0 + np.maximum(angle - wide, 0)
        high = lambda node, angle: node * 4.0 + np.minimum(angle + wide, math.pi)
        any_between = lambda keys, a, b: np.searchsorted(keys, b, "right") > np.searchsorted(keys, a)
        near = np.zeros((n, n), dtype=bool)
        meeting = [np.empty(0, np.int64)]
        for at in range(0, n, PART):
            found, queries = np.nonzero(reached[:, at : at + PART].T)
            found += at
            cosine = graph.cosine(queries, found)
            close = (queries != found) & (cosine >= least - 1e-6)
            # A pair may be found from either side only.
            near[np.minimum(queries, found)[close], np.maximum(queries, found)[close]] = True
            edge = order[starts[at] : starts[min(at + PART, n)]]
            if len(edge):
                angle, turn = np.arccos(np.clip(cosine, -1, 1)), np.arccos(np.clip(edge_cosine[edge], -1, 1))
                angles, turns = np.sort(found * 4.0 + angle), np.sort(rows[edge] * 4.0 + turn)
                out = any_between(angles, low(rows[edge], turn), high(rows[edge], turn))
                own = any_between(turns, low(found, angle), high(found, angle))
                meeting += [np.unique(to[edge[out]]), nodes[np.unique(queries[own])]]
        del reached
        meeting = np.unique(np.concatenate(meeting))

        earlier = marks(shard["shards"], here)
        links, root = np.zeros(n, dtype=np.int64), np.arange(n)
        for at in range(0, n, PART):
            a, b = np.nonzero(near[at : at + PART])
            a += at
            true = linked(plain, a, b, least)
            a, b = a[true], b[true]
            owned = ~in_common(earlier, a, b)
            np.add.at(links, a[owned], copies[b[owned]])
            np.add.at(links, b[owned], copies[a[owned]])
            root = joined(root, a, b)
        return pa.table(
            {
                "exit": np.r_[np.zeros(n, np.int32), np.ones(len(meeting), np.int32)],
                "node": np.r_[nodes, np.full(len(meeting), here)],
                "other": np.r_[nodes[root], meeting],
                "links": np.r_[links, np.zeros(len(meeting), np.int64)],
            }
        )

    return run


def search_across(least: float):
    """One meeting of nodes: links between those that no shard holds both of, compared block by block.

    kind 0: links, and hooks to join components; a pair that meets in several places is counted in the first of
    them. kind 1: ends of links that a member of this shard has, whose neighbours in the graph are to come too.
    kind 2: ends of other links, and a shard of one end, where they are to meet.
    """

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("node")
        here = cell["cell"][0].as_py()
        nodes, copies, plain = cell["node"].to_numpy(), cell["copies"].to_numpy(), matrix(cell["vector"])
        n, directions = len(nodes), unit(plain)
        together, earlier = marks(cell["shards"]), marks(cell["cells"], here)
        lists = cell["shards"].combine_chunks()
        member = np.zeros(n, dtype=bool)
        member[np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())[lists.flatten().to_numpy() == here]] = True
        # The first shard of each node, and which of them it and the others are in already.
        homes, home = np.unique(pc.list_element(lists, 0).to_numpy(), return_inverse=True)
        lists = cell["cells"].combine_chunks()
        met, row = lists.flatten().to_numpy(), np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
        at = np.searchsorted(homes, met).clip(max=len(homes) - 1)
        there = np.zeros((n, len(homes)), dtype=bool)
        there[row[homes[at] == met], at[homes[at] == met]] = True
        links, root, ends = np.zeros(n, dtype=np.int64), np.arange(n), np.zeros(n, dtype=bool)
        absent = [np.empty(0, np.int64)]
        size = max(1, 1_000_000 // n)
        for at in range(0, n, size):
            a, b = np.nonzero(directions[at : at + size] @ directions[at:].T >= least - 1e-6)
            a, b = a[a < b] + at, b[a < b] + at
            apart = ~in_common(together, a, b)
            a, b = a[apart], b[apart]
            # What an earlier meeting counts is looked at only where it could bring someone new.
            owned, own = ~in_common(earlier, a, b), member[a] | member[b]
            asked = owned | np.where(own, ~(ends[a] & ends[b]), ~(there[a, home[a]] & there[b, home[a]]))
            a, b, owned, own = a[asked], b[asked], owned[asked], own[asked]
            true = linked(plain, a, b, least)
            a, b, owned, own = a[true], b[true], owned[true], own[true]
            np.add.at(links, a[owned], copies[b[owned]])
            np.add.at(links, b[owned], copies[a[owned]])
            root = joined(root, a, b)
            ends[a[own]], ends[b[own]] = True, True
            for x in (a[~own], b[~own]):
                place = home[a[~own]]
                absent.append(np.unique((place * n + x)[~there[x, place]]))
        absent = np.unique(np.concatenate(absent))
        told = np.flatnonzero((links > 0) | (root != np.arange(n)))
        ends = np.flatnonzero(ends)
        counts = [len(told), len(ends), len(absent)]
        return pa.table(
            {
                "kind": np.repeat(np.arange(3, dtype=np.int32), counts),
                "cell": np.r_[np.full(len(told) + len(ends), here), homes[absent // n]],
                "node": nodes[np.r_[told, ends, absent % n]],
                "other": np.r_[nodes[root[told]], np.zeros(len(ends) + len(absent), np.int64)],
                "links": np.r_[links[told], np.zeros(len(ends) + len(absent), np.int64)],
            }
        )

    return run


def split(members: DataFrame, overlap: int) -> DataFrame:
    """Put each class (node, place, vector) into shards: (node, shard), none above ``SHARD`` members.

    A group that is too large is cut by centres fitted on a sample of it; every member goes to its
    ``overlap`` nearest. Groups start as places; the driver sees only names and sizes of groups and
    the samples of those it splits.
    """
    spark = members.sparkSession
    groups = written(members.select("node", F.col("place").alias("shard"), "vector"), "groups")
    done = []
    for level in range(6):
        sizes = written(groups.groupBy("shard").count(), "sizes")
        large = sizes.where(F.col("count") > SHARD)
        small = groups.join(large, "shard", "left_anti")
        done.append(small.select("node", "shard"))
        if large.isEmpty():
            break
        order = Window.partitionBy("shard").orderBy("draw")
        sampled = (
            groups.join(large, "shard")
            .withColumn("draw", F.xxhash64(F.lit(level), "node"))
            .withColumn("nth", F.row_number().over(order))
            .where(F.col("nth") <= SAMPLE)
            .select("shard", "count", "vector")
        )

        def fitted(group: pa.Table) -> pa.Table:
            count = int(min(SPLIT, max(overlap + 2, math.ceil(2 * overlap * group["count"][0].as_py() / SHARD))))
            middle = centres(unit(matrix(group["vector"])), count)
            packed = pa.array([middle.astype("<f8").tobytes()], pa.binary())
            return pa.table({"shard": group["shard"][:1], "middle": packed})

        middles = sampled.groupBy("shard").applyInArrow(fitted, "shard long, middle binary")

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch["shard"].to_numpy()
                rows, shards = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for shard in np.unique(names).tolist():  # of one place, so of one length
                    own = np.flatnonzero(names == shard)
                    vectors = unit(matrix(batch["vector"].take(pa.array(own))))
                    middle = np.frombuffer(batch["middle"][int(own[0])].as_py(), "<f8").reshape(-1, vectors.shape[1])
                    far = (middle**2).sum(axis=1) - 2 * vectors @ middle.T
                    nearest = np.argsort(far, axis=1, kind="stable")[:, :overlap]
                    parts = np.array([(shard * 1_000_003 + k + 1) % (1 << 61) for k in range(len(middle))])
                    rows.append(np.repeat(own, nearest.shape[1]))
                    shards.append(parts[nearest].reshape(-1))
                picked = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch["node"].take(picked), pa.array(np.concatenate(shards)), batch["vector"].take(picked)],
                    names=["node", "shard", "vector"],
                )

        cut = groups.join(large.select("shard"), "shard").join(middles, "shard")
        groups = written(
            cut.select("node", "shard", "vector", "middle").mapInArrow(assigned, "node long, shard long, vector array<double>"),
            "groups",
        )
    else:
        done.append(groups.select("node", "shard"))
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return written(out.distinct(), "shards")


def graph_links(
    classes: DataFrame, least: float, overlap: int, beam: int, degree: int = DEGREE, pool: int = POOL
) -> tuple[DataFrame, DataFrame]:
    """(node, links, nearest) of every class, and edges (a, b) that join components. Its own copies are not
    counted in links; nearest is the greatest cosine of its edges in the graph."""
    shards = split(classes, overlap)
    placed = classes.join(shards, "node")
    edges = written(
        placed.select("shard", "node", "vector")
        .groupBy("shard")
        .applyInArrow(built(degree, pool), "node long, neighbour long, cosine float")
        .groupBy("node", "neighbour")
        .agg(F.max("cosine").alias("cosine")),
        "adjacency",
    )
    adjacency = edges.groupBy("node").agg(F.collect_list(F.struct("neighbour", "cosine")).alias("edges"))
    lists = shards.groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    empty = F.array().cast("array<struct<neighbour:bigint,cosine:float>>")
    members = written(
        classes.join(lists, "node")
        .join(adjacency, "node", "left")
        .select("node", "copies", "vector", "shards", F.coalesce("edges", empty).alias("edges")),
        "graph",
    )
    found = written(
        members.withColumn("shard", F.explode("shards"))
        .groupBy("shard")
        .applyInArrow(search_shard(least, SLACK, beam), "exit int, node long, other long, links long"),
        "searched",
    )
    hooks = found.where("exit = 0 and node != other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    counts = found.where("exit = 0").select("node", "links")
    meetings = found.where("exit = 1").select(F.col("node").alias("cell"), F.col("other").alias("node"))
    place = members.select("node", "copies", "vector", "shards")
    near = edges.where(F.col("cosine") >= least - SLACK).select("node", "neighbour")
    across = None
    while across is None or not new.isEmpty():
        meetings = meetings if across is None else meetings.unionAll(new)
        cells = meetings.groupBy("node").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
        across = written(
            place.join(cells, "node")
            .withColumn("cell", F.explode("cells"))
            .groupBy("cell")
            .applyInArrow(search_across(least), "kind int, cell long, node long, other long, links long"),
            "across",
        )
        # What the union graph joins to either end may be near the other.
        beside = across.where("kind = 1").join(near, "node").select("cell", F.col("neighbour").alias("node"))
        asked = across.where("kind = 2").select("cell", "node").unionAll(beside).distinct()
        new = written(asked.join(meetings, ["cell", "node"], "left_anti"), "meetings")
    counts = counts.unionAll(across.where("kind = 0").select("node", "links"))
    own_hooks = across.where("kind = 0 and node != other")
    hooks = hooks.unionAll(own_hooks.select(F.col("node").alias("a"), F.col("other").alias("b")))
    nearest = edges.groupBy("node").agg(F.max("cosine").alias("nearest"))
    links = counts.groupBy("node").agg(F.sum("links").alias("links")).join(nearest, "node", "left")
    return written(links, "links"), hooks


def exact_links(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(node, links), and edges that join components, by comparing all classes of a place, block by block."""
    count = F.ceil(F.count(F.lit(1)) * F.lit(2) / F.lit(SHARD)).cast("long").alias("blocks")
    cells = (
        classes.join(classes.groupBy("place").agg(count), "place")
        .withColumn("own", F.pmod(F.xxhash64(F.lit(43), "node"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .select("place", "low", "high", "own", "node", "copies", "vector")
    )

    def compared(cell: pa.Table) -> pa.Table:
        nodes, copies, plain = cell["node"].to_numpy(), cell["copies"].to_numpy(), matrix(cell["vector"])
        own, low, high = cell["own"].to_numpy(), cell["low"][0].as_py(), cell["high"][0].as_py()
        rows, columns, directions = np.flatnonzero(own == low), np.flatnonzero(own == high), unit(plain)
        pairs = [np.empty((2, 0), np.int64)]
        for at in range(0, len(rows), 500):
            part = rows[at : at + 500]
            x, y = np.nonzero(directions[part] @ directions[columns].T >= least - 1e-6)
            a, b = part[x], columns[y]
            if low == high:
                a, b = a[a < b], b[a < b]
            true = linked(plain, a, b, least)
            pairs.append(np.stack([a[true], b[true]]))
        a, b = np.concatenate(pairs, axis=1)
        links = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        return pa.table({"node": nodes, "other": nodes[local_roots(len(nodes), a, b)], "links": links})

    found = written(
        cells.groupBy("place", "low", "high").applyInArrow(compared, "node long, other long, links long"), "compared"
    )
    hooks = found.where("node != other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    return written(found.groupBy("node").agg(F.sum("links").alias("links")), "links"), hooks


def audited(classes: DataFrame, links: DataFrame, least: float, sample: int = AUDIT) -> float:
    """The mean share of a class's links that was found, by comparing samples with every class: the lesser one
    of a sample of all classes and of a sample of those that may have links, which may be few among all.

    These are the classes with a link and, where ``links`` tells the ``nearest`` edge in the graph, those with
    an edge down to ``SLACK`` below ``least``, so that classes that lost all their links are drawn too. Every
    class with links counts alike, however many copies it has.
    """
    linked_to = links if "nearest" in links.columns else links.withColumn("nearest", F.lit(None).cast("double"))
    drawn = classes.join(linked_to, "node", "left").select(
        "node",
        "place",
        "vector",
        F.coalesce("links", F.lit(0)).alias("found"),
        F.coalesce(F.col("nearest") >= least - SLACK, F.lit(False)).alias("near"),
        F.xxhash64(F.lit(41), "node").alias("draw"),
    )
    samples = [rows.orderBy("draw").limit(sample).toArrow() for rows in (drawn, drawn.where("near or found > 0"))]
    chosen = {row["node"]: row for rows in samples for row in rows.to_pylist()}
    nodes, places = list(chosen), np.array([row["place"] for row in chosen.values()])
    vectors = [np.array(row["vector"]) for row in chosen.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(nodes), dtype=np.int64)
        for batch in batches:
            own_places, own = batch["place"].to_numpy(), batch["vector"].to_pylist()
            ids, copies = batch["node"].to_numpy(), batch["copies"].to_numpy()
            for place in set(places.tolist()):
                rows = np.flatnonzero(own_places == place)
                if len(rows):
                    asked = np.flatnonzero(places == place)
                    block, queries = np.array([own[r] for r in rows]), np.array([vectors[q] for q in asked])
                    x, q = np.nonzero(unit(block) @ unit(queries).T >= least - 1e-6)
                    true = linked(np.vstack([block, queries]), x, len(block) + q, least)
                    x, q = rows[x[true]], asked[q[true]]
                    other = ids[x] != np.array(nodes, dtype=np.int64)[q]
                    np.add.at(total, q[other], copies[x[other]])
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(total)], names=["node", "true_links"])

    partial = classes.mapInArrow(run, "node long, true_links long")
    truth = {row["node"]: row["n"] for row in partial.groupBy("node").agg(F.sum("true_links").alias("n")).collect()}
    shares = []
    for rows in samples:
        asked = zip(rows["node"].to_pylist(), rows["found"].to_pylist(), strict=True)
        own = [min(found / truth[node], 1.0) for node, found in asked if truth.get(node)]
        shares.append(sum(own) / len(own) if own else 1.0)
    return min(shares)


def near_duplicates(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """Link vectors (vec_id, embedding, label) of equal label whose cosine is at least ``least``.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable by links,
    itself included) and kept (vec_id = component_id), one row per row. Equal vectors of a label form a
    class that is searched once; its copies count in n_links.

    Each label is split into overlapping cluster shards; a robust-pruned graph is built in every shard, the
    adjacency lists, with a spanning tree of each shard, are united, and each class searches the united
    graph from its shards' medoids and itself. Edges that leave a shard are followed in joins until no link
    is new. All links are checked in double precision. Samples are audited against all vectors; below
    ``RECALL`` the graph is built again with more overlap, a wider beam and more edges, and after
    ``ATTEMPTS`` all vectors of a label are compared, block by block.

    Vectors that are null, empty, zero, or hold null or non-finite components, rows with a null label or
    null vec_id: no links and their own component (null and kept for a null vec_id). Vectors of different
    lengths do not link. Rows of one vec_id are rows of their own. Other columns are not read. No vectors
    give no rows.
    """
    spark = vectors.sparkSession
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.col("label").cast("string").alias("label"),
    )
    takes_part = usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    with small_batches(spark, 2000):
        classes = written(
            given.where(takes_part)
            .groupBy("label", "vector")
            .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
            .select(
                F.xxhash64(F.lit(1), "label", "vector").alias("node"),
                F.pmod(F.xxhash64(F.lit(2), "label", F.size("vector")), F.lit(1 << 61)).alias("place"),
                "label",
                "vector",
                "first_id",
                "copies",
            ),
            "vector_classes",
        )
        members = classes.select("node", "place", "vector", "copies")
        for k in range(ATTEMPTS):
            wider = 2**k
            links, hooks = graph_links(members, least, OVERLAP + 2 * k, BEAM * wider, DEGREE * wider, POOL * wider)
            if audited(classes, links, least) >= RECALL:
                break
        else:
            links, hooks = exact_links(members, least)
        roots = classes.join(components(hooks), "node", "left").withColumn("root", F.coalesce("root", "node"))
        smallest = written(roots.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
        known = written(
            roots.join(smallest, "root")
            .join(links, "node", "left")
            .select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
            "known",
        )
    node = F.when(takes_part, F.xxhash64(F.lit(1), "label", "vector"))
    component = F.coalesce("component_id", "vec_id")
    return (
        given.select("vec_id", node.alias("node"))
        .join(known, "node", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            component.alias("component_id"),
            F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
        )
    )


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
