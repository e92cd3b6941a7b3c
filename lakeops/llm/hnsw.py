"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Equal vectors are one node, which keeps the smallest ids of its copies, as many as a query may need. Nodes are dealt to
shards by a hash of their smallest id. A shard's graph is built in one task, whose size is bounded by the
size of a shard, and stored as one row of flat arrays: levels, neighbours, vectors and ids. Every query goes to every shard,
streams past the graph there, and the shards' results are merged. To find largest inner products by distance, each
vector gets one more component that makes all of them equally long. Scores are computed again from the original
vectors in double precision.

Edge cases: null vectors, zero vectors and those that hold null or non-finite components take no part, nor do null ids
and vectors of another length than most have; a repeated id is one vector, that of the smallest hash; ties go to the
smaller id; with fewer candidates than asked for, all are given; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.common import written


@dataclass(frozen=True)
class Settings:
    """neighbours above the ground level (twice as many on it), breadth of the search while building and asking, least number of shards and most vectors of one, and most queries that one task asks of a shard."""

    neighbours: int = 12
    build_breadth: int = 48
    breadth: int = 80
    least_shards: int = 12
    shard_rows: int = 50_000
    slice_queries: int = 20_000
    seed: int = 11


class Graph:
    """vectors: (n, d), with the component that equals lengths. links[level]: neighbours of each node of that level, -1 where there are none; rank[level]: a node's row in it."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray], entry: int):
        self.vectors, self.levels, self.links, self.entry = vectors, levels, links, entry
        self.seen, self.round = np.zeros(len(vectors), np.int32), 0

    def nearest(self, q: np.ndarray, entries: list[tuple[float, int]], breadth: int, level: int) -> list[tuple[float, int]]:
        """(distance, node) of up to `breadth` nodes, nearest first. All vectors are equally long, so minus the inner product is a distance."""
        self.round += 1
        seen, turn, links, vectors = self.seen, self.round, self.links[level], self.vectors
        near = list(entries)
        heapq.heapify(near)
        best = [(-d, v) for d, v in entries]
        heapq.heapify(best)
        for _, v in entries:
            seen[v] = turn
        while near:
            d, v = heapq.heappop(near)
            if len(best) >= breadth and d > -best[0][0]:
                break
            others = links[v]
            others = others[others >= 0]
            others = others[seen[others] != turn]
            if not len(others):
                continue
            seen[others] = turn
            for dist, u in zip((-(vectors[others] @ q)).tolist(), others.tolist(), strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (-dist, u))
                    heapq.heappush(near, (dist, u))
                elif dist < -best[0][0]:
                    heapq.heapreplace(best, (-dist, u))
                    heapq.heappush(near, (dist, u))
        return sorted((-d, v) for d, v in best)

    def descend(self, q: np.ndarray, to_level: int) -> tuple[float, int]:
        at = self.entry
        d = float(-(self.vectors[at] @ q))
        for level in range(int(self.levels[at]), to_level, -1):
            while True:
                others = self.links[level][at]
                others = others[others >= 0]
                if not len(others):
                    break
                dist = -(self.vectors[others] @ q)
                k = int(dist.argmin())
                if dist[k] >= d:
                    break
                d, at = float(dist[k]), int(others[k])
        return d, at

    def search(self, q: np.ndarray, breadth: int) -> list[tuple[float, int]]:
        if not len(self.vectors):
            return []
        return self.nearest(q, [self.descend(q, 0)], breadth, 0)

    def apart(self, near: list[int], distance: np.ndarray, most: int) -> list[int]:
        """Of candidates, nearest first, those nearer to the node than to any chosen before; filled up with the nearest of the rest."""
        between = -(self.vectors[near] @ self.vectors[near].T)
        chosen: list[int] = []
        for k in range(len(near)):
            if len(chosen) >= most:
                break
            if not chosen or distance[k] < between[k, chosen].min():
                chosen.append(k)
        rest = [k for k in range(len(near)) if k not in chosen]
        return [near[k] for k in (chosen + rest)[:most]]


def built(vectors: np.ndarray, settings: Settings) -> Graph:
    """Inserts the vectors one by one. Links of a level are rows of all nodes; upper levels are thin, so they are kept as such while building only."""
    n, m = len(vectors), settings.neighbours
    random = np.random.default_rng(settings.seed)
    levels = np.minimum((-np.log(random.uniform(1e-12, 1, n)) / math.log(m)).astype(np.int32), 6) if n else np.zeros(0, np.int32)
    top = int(levels.max()) if n else 0
    links = [np.full((n, 2 * m if level == 0 else m), -1, np.int32) for level in range(top + 1)]
    graph = Graph(vectors, levels, links, 0)
    for v in range(1, n):
        q = vectors[v]
        start = int(levels[graph.entry])
        entries = [graph.descend(q, int(levels[v]))]
        for level in range(min(start, int(levels[v])), -1, -1):
            found = graph.nearest(q, entries, settings.build_breadth, level)
            mine = links[level]
            chosen = graph.apart([u for _, u in found], np.array([d for d, _ in found]), m)
            mine[v, : len(chosen)] = chosen
            for u in chosen:
                row = mine[u]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = v
                    continue
                pool = np.append(row, v)
                dist = -(vectors[pool] @ vectors[u])
                order = np.argsort(dist, kind="stable")
                kept = graph.apart(pool[order].tolist(), dist[order], mine.shape[1])
                row[: len(kept)] = kept
            entries = found
        if levels[v] > start:
            graph.entry = v
    return graph


def flat(graph: Graph) -> dict[str, bytes]:
    """Flat arrays: links of each level for its own nodes only, one after the other."""
    parts = [links[np.flatnonzero(graph.levels >= level)].ravel() for level, links in enumerate(graph.links)]
    return {"levels": graph.levels.astype("<i4").tobytes(), "links": np.concatenate([*parts, np.zeros(0, np.int32)]).astype("<i4").tobytes()}


def unflat(vectors: np.ndarray, levels: np.ndarray, links: np.ndarray, entry: int, neighbours: int) -> Graph:
    out, at = [], 0
    for level in range(int(levels.max()) + 1 if len(levels) else 1):
        nodes = np.flatnonzero(levels >= level)
        width = 2 * neighbours if level == 0 else neighbours
        rows = np.full((len(levels), width), -1, np.int32)
        rows[nodes] = links[at : at + len(nodes) * width].reshape(-1, width)
        out.append(rows)
        at += len(nodes) * width
    return Graph(vectors, levels, out, entry)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part: one row per id, all of the same length."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.coalesce(sound, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    rows = rows.where(F.size("v") == (common[0]["d"] if common else -1))
    return rows.groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))


#: Parts that the copies of a vector are dealt to before their smallest ids are taken.
PARTS = 64


def distinct(vectors: DataFrame, most: int) -> DataFrame:
    """(id, v, ids) of each distinct vector: its smallest id and its `most` smallest ids in order."""
    for keys in (["v", F.pmod(F.xxhash64("id"), F.lit(PARTS))], ["v"]):
        vectors = vectors.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("n") <= most).drop("n")
    return vectors.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "v", "ids")


_INDEX = "shard int, ids binary, copies binary, vectors binary, levels binary, links binary, entry int"


def index(vectors: DataFrame, shards: int, longest: float, settings: Settings = Settings()) -> DataFrame:
    """One row per shard of distinct(). copies: the number of ids of each node. longest: the largest squared length of any vector."""
    names = [x.split()[0] for x in _INDEX.split(", ")]
    types = [pa.int32(), *[pa.binary()] * 5, pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, copies, rows = None, [], [], []

        def made() -> pa.RecordBatch:
            x = np.concatenate(rows)
            graph = built(lifted(x, longest), settings)
            arrays = flat(graph)
            row = [at, np.concatenate(ids).astype("<i8").tobytes(), np.concatenate(copies).astype("<i4").tobytes(), x.astype("<f8").tobytes(), arrays["levels"], arrays["links"], graph.entry]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            shard = batch.column(0).to_numpy()
            for s in np.unique(shard):  # rows come in order of shards
                part = batch.filter(pa.array(shard == s))
                if s != at and rows:
                    yield made()
                    ids, copies, rows = [], [], []
                at = int(s)
                ids.append(part.column(3).flatten().to_numpy())
                copies.append(part.column(3).value_lengths().to_numpy())
                rows.append(part.column(2).values.slice(part.column(2).offsets[0].as_py(), part.column(2).offsets[-1].as_py() - part.column(2).offsets[0].as_py()).to_numpy().reshape(part.num_rows, -1))
        if rows:
            yield made()

    dealt = vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "v", "ids").repartitionById(shards, F.col("shard")).sortWithinPartitions("id")
    return dealt.mapInArrow(run, _INDEX)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Single-precision vectors with one more component, so that all are as long as the longest."""
    rest = np.sqrt(np.maximum(0.0, longest - np.einsum("ij,ij->i", x, x)))
    return np.c_[x, rest].astype(np.float32)


def search(index: DataFrame, shards: int, queries: DataFrame, k: int, settings: Settings = Settings(), slices: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): k nearest of all shards, numbered below `shards`, to each query, without the query's own id. The index holds k + 1 ids of a vector, where it has as many.

    A task meets a shard's row first and then the queries, which stream past it in batches. slices: tasks that share
    the queries of one shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, ids, copies, starts, x = None, *[np.zeros(0, np.int64)] * 3, np.zeros((0, 1))
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for row in batch.to_pylist():
                if row["query_id"] is None:
                    ids, levels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["levels"], "<i4")
                    copies = np.frombuffer(row["copies"], "<i4").astype(np.int64)
                    starts = np.cumsum(copies) - copies
                    x = np.frombuffer(row["vectors"], "<f8").reshape(len(copies), -1)
                    longest = float(np.einsum("ij,ij->i", x, x).max())
                    graph = unflat(lifted(x, longest), levels, np.frombuffer(row["links"], "<i4"), row["entry"], settings.neighbours)
                    continue
                if graph is None:  # no vector was dealt to this shard
                    continue
                q = np.array(row["q"])
                found = np.array([v for _, v in graph.search(np.append(q, 0.0).astype(np.float32), max(settings.breadth, k + 1))], int)
                n = copies[found]
                score = np.repeat(x[found] @ q, n)
                each = ids[np.repeat(starts[found] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                others = each != row["query_id"]
                each, score = each[others], score[others]
                best = np.lexsort((each, -score))[:k]
                out.append((np.full(len(best), row["query_id"]), each[best], score[best]))
            columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, kind) for c, kind in enumerate((np.int64, np.int64, np.float64))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    slice_ids = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    graphs = index.select("shard", slice_ids, F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("q"), "ids", "copies", "vectors", "levels", "links", "entry")
    none = [F.lit(None).cast("binary").alias(c) for c in ("ids", "copies", "vectors", "levels", "links")]
    asked = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")).withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "slice", "query_id", "q", *none, F.lit(None).cast("int").alias("entry"))
    task = (F.col("shard") * slices + F.col("slice")).cast("int")
    dealt = graphs.unionByName(asked).repartitionById(shards * slices, task).sortWithinPartitions(F.col("query_id").asc_nulls_first())
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, queries: DataFrame, k: int, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Indexes df and searches it for each row of queries, which have the same columns."""
    vectors = written(usable(df, id_col, vector_col), "vectors")
    nodes = written(distinct(vectors, k + 1), "nodes")
    size = nodes.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).first()
    shards = max(settings.least_shards, -(-size["n"] // settings.shard_rows))
    graphs = written(index(nodes, shards, size["longest"] or 0.0, settings), "graphs")
    asked = queries.select(F.col(id_col).cast("long").alias("id")).distinct()
    asked = written(vectors.join(asked, "id", "left_semi"), "asked")
    return search(graphs, shards, asked, k, settings, max(1, -(-asked.count() // settings.slice_queries)))
