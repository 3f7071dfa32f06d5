"""Approximate nearest neighbours (Euclidean) by robust-pruned directed graphs, one a shard.

Equal vectors are one node, which holds their LEAST smallest ids, so a vector that
very many rows share is one point of the graph and its ids still come in order. Nodes are dealt
to shards by a hash of the vector, about SHARD_NODES each; a shard's graph is built in
one task from its own nodes: greedy searches from the node nearest to the mean propose
neighbours, and relaxed distance pruning keeps a proposal only if no kept neighbour is
RELAX times nearer to it than the node is. Searches advance many at once, a step each
at a time, in numpy. Nodes that no search can reach get an edge from the nearest node
that one can reach, so that every node can be found; a shard of at most BEAM nodes is
searched whole. Dense lumps would fill a beam and end its search, so near copies follow a
leader: the graph has leaders only, and a search looks through the followers of all found leaders
that may have one of the k nearest, by the triangle inequality.

build() returns the index as rows (nodes and their edges), to be written and searched as
often as one likes. search() sends each query to every shard; a task reads a shard's
nodes once and then its queries in batches, so it holds one shard and one batch, however
many queries there are. Results are ranked by distances in double precision on the
original vectors.

Vectors that are null, zero, or hold null or non-finite components take no part, neither
as candidates nor as queries; nor do null ids. Vectors are comparable with those of their own length only,
and each length has shards of its own. Rows with equal ids are rows of their own; a
query leaves out the rows with its own id. Ties go to the smaller id. A table with no
more than k candidates gives all of them; an empty one gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SHARD_NODES = 4096
DEGREE, BEAM, RELAX, SEED = 32, 96, 1.2, 13
SEARCHED = 128  # searches advanced at once
INDEX = "dims int, shard int, node int, ids array<long>, vector array<double>, leader int, radius double, edges array<int>"
HITS = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def points(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, vector (doubles) and dims of the rows that take part."""
    vector = F.col(f"`{vector_column}`").cast("array<double>")
    return rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("dims", F.size("vector"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of a (m, d) to b (m, k, d), by row."""
    diff = b - a[:, None, :]
    return np.einsum("mkd,mkd->mk", diff, diff)


class Graph:
    """Nodes of one shard; each one's leader; the leaders' edges, a row of node numbers each, filled up with -1."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None = None, leader: np.ndarray | None = None, radius: float = 0.0) -> None:
        self.vectors, self.n, self.edges, self.radius = vectors, len(vectors), edges, radius
        self.leader = np.arange(self.n) if leader is None else leader
        self.near = np.asarray(vectors, np.float32)
        starts = np.flatnonzero(self.leader == np.arange(self.n))
        self.entry = int(starts[((self.near[starts] - self.near[starts].mean(0)) ** 2).sum(1).argmin()])
        order = np.argsort(self.leader, kind="stable")
        self.group = np.split(order, np.searchsorted(self.leader[order], np.arange(1, self.n)))  # by leader, itself included

    def nearest(self, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query nodes, and their distances, that have the k nearest of those led by what a beam finds."""
        whole = self.n <= BEAM
        found = None if whole else self.search(queries.astype(np.float32), max(BEAM, 2 * k))[0]
        for i, query in enumerate(queries):
            if whole:
                nodes = np.arange(self.n)
            else:
                leaders = found[i][found[i] >= 0]
                far = np.sqrt(((self.vectors[leaders] - query) ** 2).sum(1))
                most = np.partition(far, k - 1)[k - 1] if len(far) >= k else np.inf
                nodes = np.concatenate([self.group[j] for j in leaders[far - self.radius * (1 + 1e-9) <= most]])
            yield nodes, np.sqrt(((self.vectors[nodes] - query) ** 2).sum(1))

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam nearest nodes that a greedy search meets for each query, and their squared distances; -1 and inf where there are fewer."""
        m = len(queries)
        found, far = np.full((m, beam), -1), np.full((m, beam), np.inf, np.float32)
        seen = np.zeros((m, self.n), bool)
        done = np.ones((m, beam), bool)
        found[:, 0], far[:, 0], done[:, 0] = self.entry, ((queries - self.near[self.entry]) ** 2).sum(1), False
        seen[:, self.entry] = True
        going = np.arange(m)
        while len(going):
            best = np.argmin(done[going], 1)  # beams are in order: the first that isn't done is the nearest
            going, best = (x[~done[going, best]] for x in (going, best))
            if not len(going):
                break
            done[going, best] = True
            next_ = self.edges[found[going, best]]
            fresh = (next_ >= 0) & ~seen[going[:, None], next_]
            seen[going[:, None], np.where(next_ >= 0, next_, found[going, best][:, None])] = True
            far_next = np.where(fresh, distances(queries[going], self.near[next_]), np.inf).astype(np.float32)
            every, far_every = np.concatenate([found[going], next_], 1), np.concatenate([far[going], far_next], 1)
            done_every = np.concatenate([done[going], ~fresh], 1)
            order = np.argsort(far_every, 1, kind="stable")[:, :beam]
            found[going], far[going], done[going] = (np.take_along_axis(x, order, 1) for x in (every, far_every, done_every))
        found[~np.isfinite(far)] = -1
        return found, far

    def pruned(self, nodes: np.ndarray, proposed: np.ndarray, relax: float) -> np.ndarray:
        """DEGREE neighbours at most for each node of those proposed (-1: none): from the nearest on, dropping what a kept one is relax times nearer to."""
        proposed = np.where(proposed == nodes[:, None], -1, proposed)
        ordered = np.sort(proposed, 1)
        again = np.zeros(ordered.shape, bool)
        again[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
        proposed = np.where(again, -1, ordered)
        shifted = self.near[proposed] - self.near[nodes][:, None, :]
        far = np.where(proposed >= 0, np.einsum("mkd,mkd->mk", shifted, shifted), np.inf)
        order = np.argsort(far, 1, kind="stable")
        proposed, far, shifted = np.take_along_axis(proposed, order, 1), np.take_along_axis(far, order, 1), np.take_along_axis(shifted, order[:, :, None], 1)
        between = np.where(proposed >= 0, far, 0)
        between = between[:, :, None] + between[:, None, :] - 2 * (shifted @ shifted.transpose(0, 2, 1))
        out, alive = np.full((len(nodes), DEGREE), -1), np.isfinite(far)
        for k in range(DEGREE):
            best = np.argmax(alive, 1)
            rows = np.flatnonzero(alive[np.arange(len(nodes)), best])
            if not len(rows):
                break
            out[rows, k] = proposed[rows, best[rows]]
            alive[rows, best[rows]] = False
            alive[rows] &= relax * relax * between[rows, best[rows]] > far[rows]
        return out

    def build(self) -> None:
        """Edges of the leaders: two passes over them, SEARCHED at a time, pruning by distance alone first, relaxed after it."""
        rng = np.random.default_rng(SEED)
        self.lead(rng)
        nodes = np.flatnonzero(self.leader == np.arange(self.n))
        part = Graph(self.vectors[nodes])
        part.connect(rng)
        self.entry, self.edges = int(nodes[part.entry]), np.full((self.n, part.edges.shape[1]), -1)
        self.edges[nodes] = np.where(part.edges >= 0, nodes[part.edges], -1)

    def lead(self, rng: np.random.Generator) -> None:
        """Deal near copies to leaders within a radius: the largest, of halves of the usual distance, at which most leaders are alone."""
        some = rng.integers(0, self.n, (2, 1024))
        self.radius = float(np.sqrt(np.median(((self.vectors[some[0]] - self.vectors[some[1]]) ** 2).sum(1)))) / 2
        order, middle = rng.permutation(self.n), self.vectors.mean(0)
        vectors = self.vectors[order] - middle
        squares = (vectors**2).sum(1)
        while True:
            leader, leaders = np.full(self.n, -1), np.empty(0, np.int64)
            for low in range(0, self.n, 256):
                block = np.arange(low, min(low + 256, self.n))
                known = np.concatenate([leaders, block])
                far = squares[block][:, None] + squares[known] - 2 * (vectors[block] @ vectors[known].T) <= self.radius**2
                old = far[:, : len(leaders)]
                if len(leaders):
                    leader[block] = np.where(old.any(1), leaders[old.argmax(1)], -1)
                within, new = far[:, len(leaders) :], []
                for i in np.flatnonzero(leader[block] < 0):
                    if leader[block[i]] < 0:
                        mine = within[i] & (leader[block] < 0)
                        mine[i] = True
                        leader[block[mine]] = block[i]
                        new.append(block[i])
                leaders = np.concatenate([leaders, np.array(new, np.int64)])
            if 2 * (np.bincount(leader, minlength=self.n)[leaders] == 1).sum() >= len(leaders) or not self.radius > 1e-6:
                break
            self.radius /= 2
        self.leader = np.empty(self.n, np.int64)
        self.leader[order] = order[leader]

    def connect(self, rng: np.random.Generator) -> None:
        first = rng.integers(0, self.n, (self.n, min(DEGREE, self.n)))
        self.edges = np.full((self.n, DEGREE), -1)
        self.edges[:, : first.shape[1]] = np.where(first == np.arange(self.n)[:, None], -1, first)
        for relax in (1.0, RELAX):
            order = rng.permutation(self.n)
            for at in range(0, self.n, SEARCHED):
                nodes = order[at : at + SEARCHED]
                found, _ = self.search(self.near[nodes], BEAM)
                self.edges[nodes] = self.pruned(nodes, np.concatenate([found, self.edges[nodes]], 1), relax)
                self.link_back(nodes, relax)
        self.reach_all()

    def link_back(self, nodes: np.ndarray, relax: float) -> None:
        """Edges back from the neighbours of nodes; what exceeds DEGREE is pruned."""
        source, target = np.repeat(nodes, DEGREE), self.edges[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        order = np.lexsort((source, target))
        source, target = source[order], target[order]
        ends, first, count = np.unique(target, return_index=True, return_counts=True)
        new = np.full((len(ends), count.max()), -1)
        new[np.repeat(np.arange(len(ends)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        for low in range(0, len(ends), SEARCHED):
            part = slice(low, low + SEARCHED)
            old = self.edges[ends[part]]
            fresh = np.where((new[part][:, :, None] == old[:, None, :]).any(2), -1, new[part])
            room = (old < 0).sum(1) >= (fresh >= 0).sum(1)
            rows = np.flatnonzero(room)
            packed = np.sort(np.concatenate([old[rows], fresh[rows]], 1), 1)[:, ::-1][:, :DEGREE]
            self.edges[ends[part][rows]] = packed
            rows = np.flatnonzero(~room)
            if len(rows):
                self.edges[ends[part][rows]] = self.pruned(ends[part][rows], np.concatenate([old[rows], fresh[rows]], 1), relax)

    def reach_all(self) -> None:
        """An edge to every node that can't be reached from the entry, from the nearest that can, beyond DEGREE if need be."""
        reached, now = np.zeros(self.n, bool), np.array([self.entry])
        while True:
            while len(now):
                reached[now] = True
                now = np.unique(self.edges[now])
                now = now[(now >= 0)]
                now = now[~reached[now]]
            left = np.flatnonzero(~reached)
            if not len(left):
                return
            known = np.flatnonzero(reached)
            far = ((self.near[known] - self.near[left[0]]) ** 2).sum(1)
            parent = known[far.argmin()]
            free = np.flatnonzero(self.edges[parent] < 0)
            if not len(free):
                self.edges = np.concatenate([self.edges, np.full((self.n, 1), -1)], 1)
                free = np.array([self.edges.shape[1] - 1])
            self.edges[parent, free[0]] = left[0]
            now = left[:1]


def in_order(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of sorted batches with equal keys."""
    for batch in batches:
        values = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        if not batch.num_rows:
            continue
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([v[1:] != v[:-1] for v in values], 0)
        first = np.append(np.flatnonzero(new), batch.num_rows)
        for low, high in zip(first[:-1], first[1:], strict=True):
            yield tuple(int(v[low]) for v in values), batch.slice(low, high - low)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def build(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 10) -> DataFrame:
    """The index of all rows that take part, as INDEX has it; a written table. Good for searches of up to k results."""
    all_points = points(rows, id_column, vector_column)
    first = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    few = all_points.withColumn("rank", first).where(F.col("rank") <= k + 1)  # limited before the shuffle too; one of the ids may be the query's
    nodes = written(few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("dims").alias("dims")), "vamana-nodes")
    # a row for each length that vectors have
    shards = nodes.groupBy("dims").agg(F.ceil(F.count("*") / SHARD_NODES).alias("shards"))
    dealt = nodes.join(F.broadcast(shards), "dims").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))
    tasks = max(1, int(shards.agg(F.sum("shards")).first()[0] or 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def made() -> Iterator[pa.RecordBatch]:
            part = pa.Table.from_batches(held).combine_chunks()
            vectors = matrix(part.column("vector").chunk(0), now[0])
            graph = Graph(vectors)
            graph.build()
            edges = [row[row >= 0].tolist() for row in graph.edges]
            n = len(vectors)
            columns = {"dims": pa.array(np.full(n, now[0], np.int32)), "shard": pa.array(np.full(n, now[1], np.int32)), "node": pa.array(np.arange(n, dtype=np.int32)), "ids": part.column("ids"), "vector": part.column("vector")}
            columns |= {"leader": pa.array(graph.leader.astype(np.int32)), "radius": pa.array(np.full(n, graph.radius)), "edges": pa.array(edges, pa.list_(pa.int32()))}
            yield from pa.table(columns).to_batches(1024)

        for key, part in in_order(batches, ["dims", "shard"]):
            if key != now and held:
                yield from made()
                held = []
            now = key
            held.append(part)
        if held:
            yield from made()

    sorted_ = dealt.select("dims", "shard", "ids", "vector").repartition(tasks, "dims", "shard").sortWithinPartitions("dims", "shard", "vector")
    return written(sorted_.mapInArrow(run, INDEX), "vamana-index")


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for every query that takes part. index: of build(), for as large a k."""
    asked = points(queries, id_column, vector_column)
    shards = index.select("dims", "shard").distinct()
    empty = lambda kind: F.lit(None).cast(kind)
    sent = asked.join(F.broadcast(shards), "dims")  # a shard a thousand nodes: its list is small
    rows = index.select("dims", "shard", F.lit(0).alias("kind"), "node", empty("long").alias("query_id"), "ids", "vector", "leader", "radius", "edges")
    rows = rows.unionByName(sent.select("dims", "shard", F.lit(1).alias("kind"), empty("int").alias("node"), F.col("id").alias("query_id"), empty("array<long>").alias("ids"), "vector", empty("int").alias("leader"), empty("double").alias("radius"), empty("array<int>").alias("edges")))
    tasks = max(1, shards.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard, graph, ids = None, None, []
        for (dims, number, kind), part in in_order(batches, ["dims", "shard", "kind"]):
            if kind == 0:
                if shard != (dims, number):
                    shard, held, graph = (dims, number), [], None
                held.append(part)
                continue
            if shard != (dims, number):
                continue  # a shard without nodes
            if graph is None:
                whole = pa.Table.from_batches(held).combine_chunks()
                vectors = matrix(whole.column("vector").chunk(0), dims)
                ids = whole.column("ids").to_pylist()
                lists = whole.column("edges").to_pylist()
                edges = np.full((len(lists), max(1, max(map(len, lists)))), -1)
                for row, line in zip(edges, lists, strict=True):
                    row[: len(line)] = line
                graph, held = Graph(vectors, edges, whole.column("leader").to_numpy(), whole.column("radius")[0].as_py()), []
            names, vectors = part.column("query_id").to_pylist(), matrix(part.column("vector"), dims)
            for low in range(0, len(names), SEARCHED):
                yield from hits(graph, ids, names[low : low + SEARCHED], vectors[low : low + SEARCHED])

    def hits(graph: Graph, ids: list[list[int]], names: list[int], vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, float]] = []
        for name, (nodes, far) in zip(names, graph.nearest(vectors, k + 1), strict=True):  # one may be the query itself
            every = sorted((f, i) for f, node in zip(far.tolist(), nodes.tolist(), strict=True) for i in ids[node] if i != name)
            out += [(name, i, f) for f, i in every[:k]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    near = rows.repartition(tasks, "dims", "shard").sortWithinPartitions("dims", "shard", "kind", "node", "query_id").mapInArrow(run, HITS)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Searches all rows of (vec_id, embedding) for the k nearest of each row whose id is divisible by every."""
    return search(build(rows, k=k), rows.where(F.col("vec_id") % every == 0), k)
