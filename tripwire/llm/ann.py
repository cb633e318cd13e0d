"""Approximate nearest neighbours: robust-pruned directed graphs, one a shard.

Distinct vectors are dealt by hash to shards of a bounded number of vectors.
Each shard's graph grows in batches: a greedy beam search from the medoid
proposes neighbours for the new vectors, and relaxed distance pruning keeps
close and diverse edges, forth and back.  Queries go in blocks to every shard;
a beam search answers them there, and the best of all shards remain.

Equal vectors are one node.  Of their ids only the smallest few can ever be
among a query's nearest, so a node keeps those: exact, and bounded for any
number of copies.  Scores are cosines in double precision of the original
vectors; only the graph works on normalised single precision.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripwire.llm.common import arrow_batch, slices, table, written

SHARD_ROWS = 8192
QUERY_BLOCK = 1024
NEAREST = 5
QUERY_MODULUS = 50
DEGREE = 24         # edges kept by pruning; a node is pruned again when it has twice as many
BUILD_BEAM = 48
SEARCH_BEAM = 96
RELAX = 1.2         # of the pruning distance
BATCH = 512
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("dim", T.IntegerType()),
                        T.StructField("key", T.BinaryType()), T.StructField("vector", T.BinaryType())])
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def valid_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows that take part: an id, and a vector that is neither null nor zero and has only finite components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=-1):
            rows = []
            for i, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not values or None in values:
                    continue
                v = np.array(values, np.float64)
                if np.isfinite(v).all() and np.isfinite(n := np.linalg.norm(v)) and n > 0:
                    raw = (v + 0.0).tobytes()       # -0.0 is 0.0
                    rows.append((i, len(v), hashlib.md5(raw).digest(), raw))
            yield arrow_batch(VECTORS, list(zip(*rows)) or [[], [], [], []])
    return embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).mapInArrow(run, VECTORS)


class Graph:
    """A directed graph over the rows of ``x`` (normalised); row -1 of ``edges`` entries means none."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 7):
        self.x, self.degree = np.ascontiguousarray(x, np.float32), degree
        self.edges = np.full((len(x), 2 * degree), -1, np.int32)
        self.count = np.zeros(len(x), np.int32)
        order = np.random.default_rng(seed).permutation(len(x))
        self.entry = int((self.x @ self.x.mean(axis=0)).argmax())
        order = np.concatenate([[self.entry], order[order != self.entry]])
        done = 1
        while done < len(order):
            new = order[done:done + min(done, BATCH)]
            near, _ = self.search(self.x[new], beam, visited=True)
            self._link(new, self._prune(new, near, relax), relax)
            done += len(new)

    def search(self, queries: np.ndarray, beam: int, visited: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The beam's rows, nearest first, with distances; or with ``visited`` all rows whose edges were followed."""
        b = len(queries)
        queries = np.ascontiguousarray(queries, np.float32)
        ids = np.full((b, beam), -1, np.int32)
        far = np.full((b, beam), np.inf, np.float32)
        followed = np.ones((b, beam), bool)
        seen = np.zeros((b, len(self.x)), bool)
        ids[:, 0], far[:, 0], followed[:, 0], seen[:, self.entry] = self.entry, 1 - queries @ self.x[self.entry], False, True
        path = []
        active = np.arange(b)
        while True:
            open_ = ~followed[active]
            going = open_.any(axis=1)
            active, open_ = active[going], open_[going]
            if not len(active):
                break
            at = open_.argmax(axis=1)       # the beam is sorted: the nearest row not followed yet
            here = ids[active, at]
            followed[active, at] = True
            step = np.full(b, -1, np.int32)
            step[active] = here
            path.append(step)
            near = self.edges[here]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            rows, columns = np.nonzero(fresh)
            targets = near[rows, columns]
            seen[active[rows], targets] = True
            distances = np.full(near.shape, np.inf, np.float32)
            distances[rows, columns] = 1 - np.einsum("ij,ij->i", queries[active[rows]], self.x[targets])
            all_far = np.concatenate([far[active], distances], axis=1)
            all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
            all_followed = np.concatenate([followed[active], ~fresh], axis=1)
            best = all_far.argsort(axis=1, kind="stable")[:, :beam]
            line = np.arange(len(active))[:, None]
            far[active], ids[active], followed[active] = all_far[line, best], all_ids[line, best], all_followed[line, best]
        if visited:
            return np.stack(path, axis=1), far
        return ids, far

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray, relax: float) -> np.ndarray:
        """At most ``degree`` candidates a node: the nearest, then those not much nearer to one already chosen."""
        out = np.full((len(nodes), self.degree), -1, np.int32)
        x = self.x[candidates]
        distance = 1 - np.einsum("ij,ikj->ik", self.x[nodes], x)
        alive = (candidates >= 0) & (candidates != nodes[:, None])
        distance[~alive] = np.inf
        line = np.arange(len(nodes))
        for turn in range(self.degree):
            pick = np.where(alive, distance, np.inf).argmin(axis=1)
            some = alive[line, pick]
            if not some.any():
                break
            out[some, turn] = candidates[line[some], pick[some]]
            apart = 1 - np.einsum("ij,ikj->ik", x[line, pick], x)
            alive &= (relax * apart > distance) & some[:, None]
            alive[line, pick] = False
        return out

    def _link(self, new: np.ndarray, chosen: np.ndarray, relax: float) -> None:
        """Set the new nodes' edges and add the edges back; nodes that overflow are pruned."""
        self.edges[new, :self.degree] = chosen
        self.count[new] = (chosen >= 0).sum(axis=1)
        rows, columns = np.nonzero(chosen >= 0)
        to, source = chosen[rows, columns], new[rows]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        nodes, first, times = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(first, times)
        room = self.count[nodes] + times <= self.edges.shape[1]
        fits = np.repeat(room, times)
        self.edges[to[fits], self.count[to[fits]] + rank[fits]] = source[fits]
        self.count[nodes[room]] += times[room]
        full = np.flatnonzero(~room)
        full = full[np.argsort(times[full])]     # like widths together
        for start in range(0, len(full), 256):
            some = full[start:start + 256]
            wide = np.full((len(some), self.edges.shape[1] + int(times[some].max())), -1, np.int32)
            wide[:, :self.edges.shape[1]] = self.edges[nodes[some]]
            for line, i in enumerate(some):
                wide[line, self.edges.shape[1]:self.edges.shape[1] + times[i]] = source[first[i]:first[i] + times[i]]
            kept = self._prune(nodes[some], wide, relax)
            self.edges[nodes[some]] = -1
            self.edges[nodes[some], :self.degree] = kept
            self.count[nodes[some]] = (kept >= 0).sum(axis=1)


def build_index(vectors: DataFrame, nearest: int = NEAREST, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The index table (``dim``, ``shard``, ``graph``) over all rows of ``valid_vectors``, and its number of shards."""
    distinct = vectors.groupBy("dim", "key", "vec_id").agg(F.first("vector").alias("vector"))
    least = Window.partitionBy("dim", "key").orderBy("vec_id")      # limited before the shuffle
    nodes = written(distinct.select("*", F.row_number().over(least).alias("place")).filter(F.col("place") <= nearest + 1)
                    .groupBy("dim", "key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector")), "ann-nodes")
    shards = max(1, math.ceil(nodes.count() / shard_rows))

    def build(group: pa.Table) -> pa.Table:
        vectors = np.frombuffer(b"".join(group["vector"].to_pylist()), np.float64).reshape(group.num_rows, -1)
        order = np.argsort(np.array(group["key"].to_pylist(), object))      # the same graph on every attempt
        vectors, ids = vectors[order], [group["ids"][int(i)].as_py() for i in order]
        graph = Graph(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
        return pa.table({"dim": pa.array([group["dim"][0].as_py()], pa.int32()), "shard": pa.array([group["shard"][0].as_py()], pa.int32()),
                         "graph": pa.array([pickle.dumps((graph, vectors, ids), 5)], pa.binary())})

    dealt = nodes.select("dim", "key", "ids", "vector", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))
    index = written(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, graph binary"), "ann-index")
    return index, shards


def search_index(index: DataFrame, shards: int, queries: DataFrame, nearest: int = NEAREST, beam: int = SEARCH_BEAM,
                 block_rows: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the nearest found over all shards of the query's dimension."""
    queries = queries.select(F.col("vec_id").alias("query_id"), "dim", "key", "vector").dropDuplicates(["query_id", "key"])
    blocks = max(1, math.ceil(queries.count() / block_rows))
    asked = queries.select("query_id", "dim", "vector", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
                           F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    held = index.select("dim", "shard", "graph", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if asked.num_rows and held.num_rows:
            graph, vectors, ids = pickle.loads(held["graph"][0].as_py())
            names = asked["query_id"].to_pylist()
            q = np.frombuffer(b"".join(asked["vector"].to_pylist()), np.float64).reshape(len(names), -1)
            size, own = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            rows, _ = graph.search(q / own[:, None], beam)
            for i, name in enumerate(names):
                at = rows[i][rows[i] >= 0]
                scores = (vectors[at] * q[i]).sum(axis=1) / (size[at] * own[i])
                best = sorted((-s, v) for r, s in zip(at.tolist(), scores.tolist()) for v in ids[r] if v != name)[:nearest]
                out += [(name, v, -s) for s, v in best]
        return pa.Table.from_batches([arrow_batch(FOUND, list(zip(*out)) or [[], [], []])])

    keys = ("dim", "shard", "block")
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(search, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score")
            .filter(F.col("rank") <= nearest))


def nearest_neighbours(embeddings: DataFrame, nearest: int = NEAREST, modulus: int = QUERY_MODULUS, beam: int = SEARCH_BEAM,
                       shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``nearest`` rows found for each query (``vec_id`` divisible by ``modulus``), by cosine, ties to the smaller id.

    A query's own row is no candidate; with fewer candidates all are returned.
    Null, zero and non-finite vectors and rows without an id take no part.
    Rows that repeat an id with the same vector count once; with other vectors
    the id's best score counts.  Vectors are only
    compared with those of their own dimension.  An empty table gives no rows.
    """
    vectors = written(valid_vectors(embeddings), "ann-vectors")
    index, shards = build_index(vectors, nearest, shard_rows)
    return search_index(index, shards, vectors.filter(F.col("vec_id") % modulus == 0), nearest, beam)


def op9_ann(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
