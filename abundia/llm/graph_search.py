"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Rows are dealt to shards by a hash of their id, so every shard is a fair sample and
none is hot. Inside a shard equal vectors are one node. Nodes enter the graph in a
seeded order, in batches that double: a greedy beam search over the graph so far
proposes neighbours for each, and robust pruning keeps an edge to the nearest
proposal and drops all others that lie more than ``RELAXED`` times closer to a kept
neighbour than to the node, so that edges stay few and point in different
directions. Edges are then put in backwards too and full nodes are pruned again.

A query is a beam search from the middle of every shard of its dimension. All nodes
of the final beam are measured again in double precision on the original vectors,
and the best of all shards are merged by query.

The index is a table, one row a vector with its shard and, on one row a node, the
node's edges; it is written once and can be searched any number of times. Shards
grow with the square root of the row count, up to ``SHARD_BYTES``, so a task's memory
is bounded and the number of shards that a query visits grows slowly. Queries reach
their shards by a shuffle and stream past the graph; they are never held together.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite
components take no part, nor do rows without a vec_id; vectors are compared with
those of their own length only; a row is never its own neighbour, nor are others
with its vec_id; equal rows count once, rows that share a vec_id but not the vector
are queries and candidates of their own; ties go to the smaller vec_id; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abundia.llm.common import saved

K = 10
#: Most edges of a node.
EDGES = 48
#: Nodes held by a beam, when building and when searching.
BUILD_BEAM = 96
BEAM = 160
RELAXED = 1.1
#: Nodes expanded in one step of a search.
WIDTH = 4
#: A shard has about this times the square root of all rows.
GROWTH = 32
SHARD_BYTES = 32 << 20
#: Searches run at once in a task.
BLOCK = 512
SEED = 13


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


class Graph:
    """A directed graph over the rows of ``points``."""

    def __init__(self, points: np.ndarray, edges: np.ndarray | None = None):
        self.points = points
        self.norms = (points * points).sum(1)
        self.edges = np.full((len(points), EDGES), -1, np.int32) if edges is None else edges
        centre = points.mean(0, dtype=np.float64).astype(points.dtype)
        self.middle = int(((points - centre) ** 2).sum(1).argmin())

    def far(self, wanted: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distance of each row of ``wanted`` to its own row of ``nodes``; infinite for no node (-1)."""
        products = np.matmul(self.points[nodes], wanted[:, :, None])[:, :, 0]
        found = self.norms[nodes] - 2 * products + (wanted * wanted).sum(1)[:, None]
        return np.where(nodes < 0, np.inf, np.maximum(found, 0))

    def search(self, wanted: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, squared distances, expanded nodes) of a beam search for each row; -1 fills up."""
        n = len(wanted)
        nodes = np.full((n, beam), -1, np.int32)
        near = np.full((n, beam), np.inf, np.float32)
        done = np.ones((n, beam), bool)
        nodes[:, 0], done[:, 0] = self.middle, False
        near[:, 0] = self.far(wanted, nodes[:, :1])[:, 0]
        trail = [np.zeros((n, 0), np.int32)]
        live = np.arange(n)
        while len(live):
            # the nearest nodes of each beam that are not yet expanded; a beam is sorted
            rank = np.cumsum(~done[live], 1)
            take = ~done[live] & (rank <= WIDTH)
            column = np.argsort(~take, 1, kind="stable")[:, :WIDTH]
            chosen = np.where(np.take_along_axis(take, column, 1), np.take_along_axis(nodes[live], column, 1), -1)
            done[live] |= take
            step = np.full((n, WIDTH), -1, np.int32)
            step[live] = chosen
            trail.append(step)
            fresh = np.where(chosen[:, :, None] < 0, -1, self.edges[chosen]).reshape(len(live), -1)
            # a node met twice in this step, or held already, is met once
            fresh.sort(1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            held = np.sort(nodes[live], 1)
            width = np.int64(len(self.points) + 1)
            base = np.arange(len(live), dtype=np.int64)[:, None] * width + 1
            flat = (held + base).ravel()
            keys = fresh + base
            at = np.minimum(np.searchsorted(flat, keys.ravel()), len(flat) - 1)
            fresh[(flat[at] == keys.ravel()).reshape(fresh.shape)] = -1
            both = np.concatenate([nodes[live], fresh], 1)
            value = np.concatenate([near[live], self.far(wanted[live], fresh).astype(np.float32)], 1)
            seen = np.concatenate([done[live], fresh < 0], 1)
            order = np.argpartition(value, beam - 1, 1)[:, :beam]
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(value, order, 1), 1, kind="stable"), 1)
            nodes[live], near[live] = np.take_along_axis(both, order, 1), np.take_along_axis(value, order, 1)
            done[live] = np.take_along_axis(seen, order, 1)
            live = live[~done[live].all(1)]
        return nodes, near, np.concatenate(trail, 1)

    def pruned(self, own: np.ndarray, proposed: np.ndarray) -> np.ndarray:
        """At most ``EDGES`` diverse neighbours of each node of ``own`` out of its row of ``proposed``."""
        proposed = np.sort(proposed, 1)
        proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = -1
        proposed[proposed == own[:, None]] = -1
        far = self.far(self.points[own], proposed)
        order = np.argsort(far, 1, kind="stable")
        proposed, far = np.take_along_axis(proposed, order, 1), np.take_along_axis(far, order, 1)
        most = int((proposed >= 0).sum(1).max(initial=0))
        proposed, far = proposed[:, :most], far[:, :most]
        out = np.full((len(own), EDGES), -1, np.int32)
        if most:
            chosen = self.points[proposed]
            between = np.matmul(chosen, chosen.transpose(0, 2, 1)) * -2
            between += self.norms[proposed][:, :, None] + self.norms[proposed][:, None]
            alive, rows = proposed >= 0, np.arange(len(own))
            for k in range(EDGES):
                best = alive.argmax(1)
                some = alive[rows, best]
                if not some.any():
                    break
                out[some, k] = proposed[rows, best][some]
                alive &= RELAXED**2 * between[rows, best] > far
                alive[rows, best] = False
        return out

    def insert(self, new: np.ndarray) -> None:
        """Give nodes their edges and put the reverse edges in."""
        for low in range(0, len(new), BLOCK):
            own = new[low : low + BLOCK]
            nodes, _, trail = self.search(self.points[own], BUILD_BEAM)
            self.edges[own] = self.pruned(own, np.concatenate([nodes, trail], 1))
        targets = self.edges[new].ravel()
        sources = np.repeat(new, EDGES)[targets >= 0]
        targets = targets[targets >= 0]
        order = np.argsort(targets, kind="stable")
        targets, sources = targets[order], sources[order]
        heads, starts, sizes = np.unique(targets, return_index=True, return_counts=True)
        done = np.zeros(len(heads), np.int64)
        while (done < sizes).any():  # a node with many new edges takes them in slices
            some = np.flatnonzero(done < sizes)
            take = np.minimum(sizes[some] - done[some], EDGES)
            held = np.full((len(some), EDGES), -1, np.int32)
            place = (starts[some] + done[some])[:, None] + np.arange(EDGES)[None]
            filled = np.arange(EDGES)[None] < take[:, None]
            held[filled] = sources[place[filled]]
            done[some] += take
            for low in range(0, len(some), BLOCK):
                own = heads[some[low : low + BLOCK]]
                self.edges[own] = self._joined(own, held[low : low + BLOCK])

    def _joined(self, own: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Edges with ``more`` put in: as they are while there is room, pruned beyond."""
        both = np.sort(np.concatenate([self.edges[own], more], 1), 1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        both = -np.sort(-both, 1)
        out = both[:, :EDGES].copy()
        full = both[:, EDGES] >= 0
        if full.any():
            out[full] = self.pruned(own[full], both[full])
        return out

    def build(self) -> Graph:
        order = np.random.default_rng(SEED).permutation(len(self.points)).astype(np.int32)
        order = np.concatenate([[self.middle], order[order != self.middle]]).astype(np.int32)
        low, size = 1, 1
        while low < len(order):
            self.insert(order[low : low + size])
            low, size = low + size, min(2 * (low + size), max(BLOCK, len(order) // 50))
        return self


def _matrix(column: pa.Array) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]].reshape(len(column), -1).astype(np.float64)


def _nodes(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of node and id without equal rows: (ids, vectors, first row of each node)."""
    single = vectors.astype(np.float64) + 0.0  # -0.0 equals 0.0
    key = np.ascontiguousarray(single).view(np.dtype((np.void, single.dtype.itemsize * single.shape[1])))[:, 0]
    _, node = np.unique(key, return_inverse=True)
    order = np.lexsort((ids, node))
    ids, node, vectors = ids[order], node[order], vectors[order]
    keep = np.ones(len(ids), bool)
    keep[1:] = (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])
    ids, node, vectors = ids[keep], node[keep], vectors[keep]
    return ids, vectors, np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Slices of batches of one (dim, shard) after another; the input is sorted by both."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column("dim").to_numpy(), batch.column("shard").to_numpy()], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high > low:
                key = tuple(keys[low])
                if last is not None and key != last:
                    yield held
                    held = []
                last = key
                held.append(batch.slice(low, high - low))
    if held:
        yield held


def index(vectors: DataFrame) -> DataFrame:
    """(dim, shard, node, vec_id, embedding, edges): the graphs of all shards; ``edges`` is null on all but a node's first row."""
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"))
    root = F.ceil(F.sqrt("n") / GROWTH)
    memory = F.ceil(F.col("n") * F.col("dim") * 4 / SHARD_BYTES)
    shards = saved(sizes.select("dim", F.greatest(root, memory).cast("int").alias("shards")))
    dealt = rows.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")).drop("shards")

    def run(batches: Iterator[pa.RecordBatch]):
        for held in _by_shard(batches):
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, points, first = _nodes(whole["vec_id"].to_numpy(), _matrix(whole["embedding"].combine_chunks()))
            edges = Graph(points[first].astype(np.float32)).build().edges
            node = np.cumsum(np.isin(np.arange(len(ids)), first)) - 1
            for low in range(0, len(ids), 4096):
                part = slice(low, low + 4096)
                lists = [edges[node[i]][edges[node[i]] >= 0].tolist() if first[node[i]] == i else None for i in range(low, min(low + 4096, len(ids)))]
                n = len(lists)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([whole["dim"][0].as_py()] * n, pa.int32()),
                        pa.array([whole["shard"][0].as_py()] * n, pa.int32()),
                        pa.array(node[part], pa.int64()),
                        pa.array(ids[part], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * points.shape[1]), pa.array(points[part].ravel())),
                        pa.array(lists, pa.list_(pa.int32())),
                    ],
                    ["dim", "shard", "node", "vec_id", "embedding", "edges"],
                )

    placed = dealt.select("dim", "shard", "vec_id", "embedding").repartition("dim", "shard").sortWithinPartitions("dim", "shard", "vec_id", "embedding")
    return saved(placed.mapInArrow(run, "dim int, shard int, node long, vec_id long, embedding array<double>, edges array<int>"))


class Shard:
    """A shard read back from its index rows."""

    def __init__(self, rows: pa.Table):
        self.ids, self.points = rows["vec_id"].to_numpy(), _matrix(rows["embedding"].combine_chunks())
        lists = rows["edges"].combine_chunks()
        self.first = np.flatnonzero(~np.asarray(lists.is_null()))
        edges = np.full((len(self.first), EDGES), -1, np.int32)
        sizes = np.diff(lists.offsets.to_numpy())[self.first]
        edges[np.arange(EDGES)[None] < sizes[:, None]] = lists.flatten().to_numpy()
        self.graph = Graph(self.points[self.first].astype(np.float32), edges)
        self.after = np.append(self.first[1:], len(self.ids))

    def answer(self, own: int, wanted: np.ndarray, nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the ``k`` best rows of the nodes found; k + 1 rows of a node hold its k smallest other ids."""
        nodes = nodes[nodes >= 0]
        rows = np.concatenate([np.arange(self.first[v], min(self.after[v], self.first[v] + k + 1)) for v in nodes])
        rows = rows[self.ids[rows] != own]
        far = np.sqrt(((self.points[rows] - wanted) ** 2).sum(1))
        order = np.lexsort((self.ids[rows], far))[:k]
        return self.ids[rows][order], far[order]


def search(graphs: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row (vec_id, embedding) of ``queries``."""
    wanted = queries.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    wanted = wanted.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim")).distinct()
    shards = saved(graphs.select("dim", "shard").distinct())
    none = lambda kind: F.lit(None).cast(kind)
    sent = wanted.join(shards, "dim").select("dim", "shard", F.lit(1).alias("kind"), none("long").alias("node"), "vec_id", "embedding", none("array<int>").alias("edges"))
    both = graphs.select("dim", "shard", F.lit(0).alias("kind"), "node", "vec_id", "embedding", "edges").union(sent)
    most = max(beam, k + 1)

    def answers(shard: Shard, rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, vectors = rows.column("vec_id").to_numpy(), _matrix(rows.column("embedding"))
        nodes = shard.graph.search(vectors.astype(np.float32), most)[0]
        found = [shard.answer(ids[i], vectors[i], nodes[i], k) for i in range(len(ids))]
        sizes = [len(f[0]) for f in found]
        place = np.repeat(np.arange(len(ids)), sizes)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[place]), rows.column("embedding").take(pa.array(place)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))],
            ["query_id", "wanted", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]):
        at, parts, shard = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "kind")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if high == low:
                    continue
                if tuple(keys[low, :2]) != at:
                    at, parts, shard = tuple(keys[low, :2]), [], None
                piece = batch.slice(low, high - low)
                if keys[low, 2] == 0:  # a shard's rows come before its queries
                    parts.append(piece)
                    continue
                if shard is None:
                    shard, parts = Shard(pa.Table.from_batches(parts)), []
                for start in range(0, piece.num_rows, BLOCK):
                    yield answers(shard, piece.slice(start, BLOCK))

    placed = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind", "node", "vec_id")
    found = placed.mapInArrow(run, "query_id long, wanted array<double>, vec_id long, score double")
    # one row of a query and shard holds its best; the vector tells queries of one id apart
    best = Window.partitionBy("query_id", "key").orderBy("score", "vec_id")
    ranked = found.select("query_id", F.xxhash64("wanted").alias("key"), "vec_id", "score").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """The ``k`` nearest found of every row whose id is divisible by ``every``, among all other rows."""
    return search(index(vectors), vectors.where(F.col("vec_id") % every == 0), k)
