"""Approximate nearest neighbours: one navigable small-world graph for each shard, results merged.

Equal vectors become one point first, with the few smallest ids that a result can need, so copies
neither break up a graph nor fill its lists. Points are dealt by a hash into shards of about
``per_shard``; each shard's graph is built once and kept as flat neighbour arrays (one int32 matrix
for each layer, -1 where a list is not full). Every query walks every shard's graph; the shards'
results are merged by distance, then id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tanik.llm.vectors import as_double, matrix, smallest_ids, usable
from tanik.session import saved

LINKS = 16
BUILD = 64


class Graph:
    """Layers of flat neighbour arrays over the rows of a matrix; Euclidean distance."""

    def __init__(self, points: np.ndarray, layers: list[np.ndarray] | None = None, entry: int = 0):
        self.points = points
        self.norms = (points * points).sum(axis=1)
        self.layers = layers or []
        self.entry = entry

    def _far(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Squared distances less the query's own norm."""
        return self.norms[rows] - 2 * (self.points[rows] @ q)

    def walk(self, q: np.ndarray, start: list[tuple[float, int]], layer: int, width: int) -> list[tuple[float, int]]:
        """Best-first search; the ``width`` nearest seen, nearest first."""
        links, seen = self.layers[layer], {n for _, n in start}
        todo, best = list(start), [(-d, n) for d, n in start]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, n = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            fresh = [m for m in links[n].tolist() if m >= 0 and m not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for far, m in zip(self._far(q, np.array(fresh)).tolist(), fresh):
                if len(best) < width:
                    heapq.heappush(best, (-far, m))
                    heapq.heappush(todo, (far, m))
                elif far < -best[0][0]:
                    heapq.heapreplace(best, (-far, m))
                    heapq.heappush(todo, (far, m))
        return sorted((-d, n) for d, n in best)

    def search(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        """The nearest points found: greedily down the upper layers, then widely in the lowest."""
        if not len(self.points):
            return []
        near = [(float(self._far(q, np.array([self.entry]))[0]), self.entry)]
        for layer in range(len(self.layers) - 1, 0, -1):
            near = self.walk(q, near, layer, 1)
        return self.walk(q, near, 0, width)

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are nearer to the point than to each other, then the nearest of the rest."""
        rows = np.array([n for _, n in found])
        if len(rows) <= most:
            return rows.tolist()
        vectors = self.points[rows]
        between = self.norms[rows][:, None] + self.norms[rows][None, :] - 2 * vectors @ vectors.T
        own = np.array([d for d, _ in found])
        kept: list[int] = []
        for k in range(len(rows)):
            if len(kept) < most and (not kept or own[k] < between[k, kept].min()):
                kept.append(k)
        kept += [k for k in range(len(rows)) if k not in set(kept)][: most - len(kept)]
        return rows[kept].tolist()

    @classmethod
    def build(cls, points: np.ndarray, links: int = LINKS, width: int = BUILD, seed: int = 1) -> Graph:
        graph = cls(points)
        draw = np.random.default_rng(seed)
        heights = np.minimum((-np.log(draw.random(len(points)) + 1e-12) / np.log(links)).astype(int), 8)
        for n in range(len(points)):
            q, top = points[n], int(heights[n])
            high = len(graph.layers) - 1
            if high >= 0:
                near = [(float(graph._far(q, np.array([graph.entry]))[0]), graph.entry)]
                for layer in range(high, -1, -1):
                    near = graph.walk(q, near, layer, width if layer <= top else 1)
                    if layer <= top:
                        graph._connect(n, near, layer, links)
            if top > high:
                graph.layers += [np.full((len(points), 2 * links if layer == 0 else links), -1, np.int32) for layer in range(high + 1, top + 1)]
                graph.entry = n
        return graph

    def _connect(self, n: int, near: list[tuple[float, int]], layer: int, links: int) -> None:
        table = self.layers[layer]
        chosen = self._spread([(d + self.norms[n], m) for d, m in near], links)
        table[n, : len(chosen)] = chosen
        for m in chosen:
            row = table[m]
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = n
            else:
                both = np.append(row, n)
                far = self._far(self.points[m], both) + self.norms[m]
                order = np.argsort(far, kind="stable")
                kept = self._spread([(float(far[k]), int(both[k])) for k in order], len(row))
                row[:] = -1
                row[: len(kept)] = kept


def _built(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([(n, "ascending") for n in ("first",)])
    points = matrix(rows.column("vector"))
    graph = Graph.build(points)
    flat = b"".join(layer.tobytes() for layer in graph.layers)
    ids = [list(map(int, x)) for x in rows.column("ids").to_pylist()]
    return pa.table({"shard": [rows.column("shard")[0].as_py()], "points": [points.tobytes()], "width": pa.array([points.shape[1]], pa.int32()), "links": [flat], "layers": pa.array([len(graph.layers)], pa.int32()), "entry": pa.array([graph.entry], pa.int32()), "ids": pa.array([ids], pa.list_(pa.list_(pa.int64())))})


_INDEX = "shard long, points binary, width int, links binary, layers int, entry int, ids array<array<long>>"


def index(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", per_shard: int = 4096, spare: int = 11) -> DataFrame:
    """One row for each shard: its points, flat neighbour arrays and the ids of each point.

    Rows whose vector is null, zero or holds null or non-finite components, or whose key is null, are
    not indexed; nor are vectors of another length than the most frequent one (the shorter, if two are).
    ``spare``: ids kept of equal vectors; ``search`` refuses to look for as many results.
    """
    good = rows.where(usable(F.col(f"`{vector}`")) & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("key"), as_double(F.col(f"`{vector}`")).alias("vector"))
    common = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = good.where(F.size("vector") == (common.n if common else 0))
    points = saved(smallest_ids(good.distinct(), ["vector"], "key", spare))
    shards = max(1, -(-points.count() // per_shard))
    dealt = points.select("vector", "ids", F.element_at("ids", 1).alias("first"), F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(shards)).alias("shard"))
    return saved(dealt.groupBy("shard").applyInArrow(_built, _INDEX).withColumn("spare", F.lit(spare)))


def _graph(row: dict) -> tuple[Graph, list[list[int]]]:
    points = np.frombuffer(row["points"]).reshape(-1, row["width"])
    n, flat, layers = len(points), np.frombuffer(row["links"], np.int32), []
    for k in range(row["layers"]):
        wide = 2 * LINKS if k == 0 else LINKS
        layers.append(flat[: n * wide].reshape(n, wide))
        flat = flat[n * wide :]
    return Graph(points, layers, row["entry"]), row["ids"]


def _searched(count: int, width: int):
    def run(key, shard: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if shard.num_rows and queries.num_rows:
            graph, ids = _graph(shard.slice(0, 1).to_pylist()[0])
            for query_id, q in zip(queries.column("query_id").to_pylist(), matrix(queries.column("vector"))):
                found = np.array([n for _, n in graph.search(q, width)])
                exact = np.sqrt(((graph.points[found] - q) ** 2).sum(axis=1))
                near = sorted((d, i) for d, n in zip(exact.tolist(), found.tolist()) for i in ids[n] if i != query_id)
                out += [(query_id, i, d) for d, i in near[:count]]
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    return run


def search(shards: DataFrame, queries: DataFrame, count: int = 10, width: int = 160, block: int = 2048, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``count`` nearest found, ties to the smaller id.

    A query's own id is not among its results. Queries come in blocks of about ``block``; each block
    meets each shard once. Queries that ``index`` would not take, or of another length than its vectors,
    find nothing; repeated query ids are one query each with the smallest vector. Empty tables give an
    empty result. ``count`` must be less than the ids that the index keeps of equal vectors.
    """
    last, length, spare = shards.agg(F.max("shard"), F.max("width"), F.min("spare")).first()
    if spare is not None and count >= spare:
        raise ValueError(f"the index keeps {spare} ids of equal vectors, which is too few to find {count}")
    good = queries.where(usable(F.col(f"`{vector}`")) & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("query_id"), as_double(F.col(f"`{vector}`")).alias("vector"))
    good = good.where(F.size("vector") == F.lit(length)).groupBy("query_id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-good.count() // block))
    if last is None:
        return good.select("query_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    asked = good.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    served = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = served.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_searched(count, width), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame) -> DataFrame:
    """The 10 nearest rows of every row whose vec_id is divisible by 100."""
    return search(index(rows), rows.where(F.col("vec_id") % 100 == 0))
