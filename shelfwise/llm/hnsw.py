"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Equal vectors are one node. Nodes are dealt to shards of about equal size by hash; in each a graph is built (Malkov and
Yashunin, 2018) and stored as flat arrays: a row per node with its neighbours of all layers behind each other.
A query visits every shard; the shards' best are merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.storage import stored

#: Nodes of a shard, about.
SHARD_ROWS = 8192
#: Neighbours of a node on upper layers; twice as many on the lowest.
LINKS = 16
#: Candidates kept while building and while searching.
BUILD_WIDTH, SEARCH_WIDTH = 64, 128
#: A query is every row whose id is divisible by this.
QUERY_STEP = 50
#: Neighbours returned.
NEAREST = 5


class Graph:
    """A graph over unit vectors. ``flat[starts[i, l]:starts[i, l + 1]]`` are the neighbours of node i on layer l."""

    def __init__(self, vectors: np.ndarray, flat: np.ndarray, starts: np.ndarray, levels: np.ndarray):
        self.vectors, self.flat, self.starts, self.levels = vectors, flat, starts, levels
        self.entry = int(np.argmax(levels)) if len(levels) else -1
        self.seen = np.zeros(len(vectors), dtype=np.int64)
        self.mark = 0

    def neighbours(self, node: int, layer: int) -> np.ndarray:
        return self.flat[self.starts[node, layer] : self.starts[node, layer + 1]]

    def search(self, query: np.ndarray, width: int) -> list[tuple[float, int]]:
        """(similarity, node) of up to ``width`` near nodes, best first."""
        if self.entry < 0:
            return []
        at, best = self.entry, float(self.vectors[self.entry] @ query)
        for layer in range(int(self.levels[self.entry]), 0, -1):
            at, best = _descend(self, query, at, best, layer)
        return _beam(self, query, [(best, at)], 0, width)


def _descend(graph, query: np.ndarray, at: int, best: float, layer: int) -> tuple[int, float]:
    """The node no neighbour of which is nearer."""
    while True:
        near = graph.neighbours(at, layer)
        if not len(near):
            return at, best
        scores = graph.vectors[near] @ query
        k = int(np.argmax(scores))
        if scores[k] <= best:
            return at, best
        at, best = int(near[k]), float(scores[k])


def _beam(graph, query: np.ndarray, start: list[tuple[float, int]], layer: int, width: int) -> list[tuple[float, int]]:
    """Best-first search of one layer with ``width`` results kept."""
    graph.mark += 1
    mark, seen = graph.mark, graph.seen
    for _, node in start:
        seen[node] = mark
    todo = [(-score, node) for score, node in start]
    heapq.heapify(todo)
    kept = list(start)
    heapq.heapify(kept)
    while todo:
        score, node = heapq.heappop(todo)
        if len(kept) >= width and -score < kept[0][0]:
            break
        near = graph.neighbours(node, layer)
        near = near[seen[near] != mark]
        if not len(near):
            continue
        seen[near] = mark
        for value, other in zip((graph.vectors[near] @ query).tolist(), near.tolist()):
            if len(kept) < width:
                heapq.heappush(kept, (value, other))
            elif value > kept[0][0]:
                heapq.heapreplace(kept, (value, other))
            else:
                continue
            heapq.heappush(todo, (-value, other))
    return sorted(kept, reverse=True)


class Builder:
    """Inserts nodes one by one; rows of neighbours have a fixed width per layer until they are packed."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray):
        n = len(vectors)
        self.vectors, self.levels = vectors, levels
        self.seen, self.mark = np.zeros(n, dtype=np.int64), 0
        self.rows = [np.zeros((n if layer == 0 else int((levels >= layer).sum()), LINKS * (1 + (layer == 0))), dtype=np.int32) for layer in range(int(levels.max(initial=0)) + 1)]
        self.size = [np.zeros(len(r), dtype=np.int32) for r in self.rows]
        self.place = [np.cumsum(levels >= layer) - 1 for layer in range(len(self.rows))]
        self.entry, self.top = 0, int(levels[0])
        for node in range(1, n):
            self._insert(node)

    def neighbours(self, node: int, layer: int) -> np.ndarray:
        at = self.place[layer][node]
        return self.rows[layer][at, : self.size[layer][at]]

    def _chosen(self, base: int, found: list[tuple[float, int]], most: int) -> list[int]:
        """Candidates nearer to the base than to any one chosen before, then the nearest of the rest."""
        nodes = np.array([node for _, node in found])
        own = np.array([score for score, _ in found])
        between = self.vectors[nodes] @ self.vectors[nodes].T
        picked: list[int] = []
        closest = np.full(len(nodes), -np.inf)
        for k in range(len(nodes)):
            if closest[k] < own[k]:
                picked.append(k)
                if len(picked) == most:
                    break
                closest = np.maximum(closest, between[k])
        if len(picked) < most:
            rest = set(range(len(nodes))) - set(picked)
            picked += sorted(rest)[: most - len(picked)]
        return nodes[picked].tolist()

    def _insert(self, node: int) -> None:
        query, level = self.vectors[node], int(self.levels[node])
        at = self.entry
        best = float(self.vectors[at] @ query)
        for layer in range(self.top, level, -1):
            at, best = _descend(self, query, at, best, layer)
        found = [(best, at)]
        for layer in range(min(self.top, level), -1, -1):
            found = _beam(self, query, found, layer, BUILD_WIDTH)
            most = self.rows[layer].shape[1]
            chosen = self._chosen(node, found, LINKS)
            row = self.place[layer][node]
            self.rows[layer][row, : len(chosen)] = chosen
            self.size[layer][row] = len(chosen)
            for other in chosen:
                to = self.place[layer][other]
                count = int(self.size[layer][to])
                if count < most:
                    self.rows[layer][to, count] = node
                    self.size[layer][to] = count + 1
                else:
                    every = np.append(self.rows[layer][to], node)
                    scores = self.vectors[every] @ self.vectors[other]
                    order = np.argsort(-scores, kind="stable")
                    kept = self._chosen(other, [(float(scores[k]), int(every[k])) for k in order], most)
                    self.rows[layer][to, : len(kept)] = kept
                    self.size[layer][to] = len(kept)
        if level > self.top:
            self.entry, self.top = node, level

    def packed(self) -> list[tuple[np.ndarray, list[int]]]:
        """Per node its neighbours of all layers behind each other, and how many each layer has."""
        out = []
        for node in range(len(self.vectors)):
            lists = [self.neighbours(node, layer) for layer in range(int(self.levels[node]) + 1)]
            out.append((np.concatenate(lists), [len(x) for x in lists]))
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that are not null or zero and have no null or non-finite component."""
    inf = float("inf")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf)) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where("vec_id IS NOT NULL").where(sound)


def nodes(vectors: DataFrame, keep: int = NEAREST + 1) -> DataFrame:
    """(node_id, embedding, ids): different vectors with their ``keep`` smallest ids; first within salts, so many copies are no one task's."""
    key = vectors.withColumn("key", F.xxhash64("embedding")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    rank = lambda *by: F.row_number().over(Window.partitionBy("key", "embedding", *by).orderBy("vec_id"))
    few = key.dropDuplicates(["vec_id", "key"]).withColumn("r", rank("salt")).where(F.col("r") <= keep)
    few = few.withColumn("r", rank()).where(F.col("r") <= keep)
    return few.groupBy("key", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("node_id"), "embedding", "ids")


_INDEX = "shard int, node int, node_id long, embedding array<double>, ids array<long>, neighbours array<int>, sizes array<int>"


def build_index(points: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The index of ``points`` (node_id, embedding, ids), a row per node, stored; and the number of shards."""
    points = stored(points)
    shards = max(1, -(-points.count() // shard_rows))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node_id", kind="stable").reset_index(drop=True)
        vectors = _units(rows["embedding"])
        draw = np.random.default_rng(len(rows)).random(len(rows))
        levels = np.floor(-np.log(1 - draw) / math.log(LINKS)).astype(np.int64)
        packed = Builder(vectors, levels).packed()
        return rows.assign(node=np.arange(len(rows), dtype=np.int32), neighbours=[p for p, _ in packed], sizes=[s for _, s in packed])[
            ["shard", "node", "node_id", "embedding", "ids", "neighbours", "sizes"]
        ]

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("node_id"), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("shard").applyInPandas(build, _INDEX)), shards


def _units(column) -> np.ndarray:
    rows = np.array([np.asarray(v, dtype=np.float64) for v in column])
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def cosine(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosines in double precision."""
    return (others @ one) / (np.linalg.norm(others, axis=1) * np.linalg.norm(one))


class Shard:
    """A shard read back from its rows."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("node")
        self.originals = np.array([np.asarray(v) for v in rows.column("embedding").to_pylist()])
        self.ids = rows.column("ids").to_pylist()
        sizes = rows.column("sizes").to_pylist()
        levels = np.array([len(s) - 1 for s in sizes])
        starts = np.zeros((len(sizes), int(levels.max()) + 2), dtype=np.int64)
        at = 0
        for k, each in enumerate(sizes):
            starts[k, : len(each) + 1] = at + np.concatenate([[0], np.cumsum(each)])
            starts[k, len(each) + 1 :] = starts[k, len(each)]
            at += sum(each)
        flat = rows.column("neighbours").combine_chunks().flatten().to_numpy()
        self.graph = Graph(_units(self.originals), flat, starts, levels)

    def nearest(self, query_id: int, query: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
        found = [node for _, node in self.graph.search(_units([query])[0], width)]
        if not found:
            return []
        scores = cosine(query, self.originals[found])
        every = [(-s, i) for s, node in zip(scores.tolist(), found) for i in self.ids[node] if i != query_id]
        return [(-s, i) for s, i in sorted(every)[:k]]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, width: int = SEARCH_WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query by cosine, ties to the smaller id.

    Both tables need vec_id and an array embedding of one length; other columns are ignored. Null, zero and non-finite vectors
    and null ids take no part on either side. A vector is no candidate of a query with its id; repeated rows count once, equal
    vectors with different ids each. With fewer candidates all are returned; empty tables give no rows.
    """
    index, shards = build_index(nodes(usable(vectors), k + 1), shard_rows)
    asked = usable(queries).dropDuplicates(["vec_id"]).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(-1).alias("node"), F.col("vec_id").alias("node_id"), "embedding"
    )
    # In each task: the rows of a shard's graph, then its queries as they come.
    rows = index.withColumn("is_query", F.lit(0)).unionByName(asked.withColumn("is_query", F.lit(1)), allowMissingColumns=True)
    rows = rows.repartition("shard").sortWithinPartitions("shard", "is_query", "node", "node_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shard = -1, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            shard_of = table.column("shard").to_numpy()
            for number in np.unique(shard_of):
                part = table.filter(pa.array(shard_of == number))
                if number != at:
                    at, parts, shard = number, [], None
                is_query = part.column("is_query").to_numpy() == 1
                if not is_query.all():
                    parts.append(part.filter(pa.array(~is_query)))
                if not is_query.any():
                    continue
                if shard is None and parts:
                    shard, parts = Shard(pa.concat_tables(parts)), []
                if shard is None:
                    continue
                out: list[list] = [[], [], []]
                some = part.filter(pa.array(is_query))
                for query_id, query in zip(some.column("node_id").to_pylist(), some.column("embedding").to_pylist()):
                    for score, vec_id in shard.nearest(query_id, np.array(query, dtype=np.float64), k, width):
                        for column, value in zip(out, (query_id, vec_id, score)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"]
                )

    found = rows.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_fiftieth(vectors: DataFrame) -> DataFrame:
    """The stated query set: rows whose vec_id is divisible by ``QUERY_STEP``."""
    return vectors.where(F.col("vec_id") % QUERY_STEP == 0)
