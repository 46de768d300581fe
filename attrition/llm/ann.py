"""Approximate nearest neighbours by cosine: robust-pruned directed graphs, one per shard.

Vectors are dealt by hash into shards of bounded size.  A shard's graph starts
from random edges; its points are then taken in batches, greedy beam searches on
the graph so far propose neighbours, and pruning keeps an edge to a candidate
only if no kept neighbour is nearer to the candidate by the factor ``alpha``.
Reverse edges are added and pruned likewise.  A query runs a beam search in each
shard of its dimension, and the exact cosines of what it finds, in double
precision, decide.

Equal vectors are one point of a graph (copies would crowd out all other edges)
and are told apart again in the result; as at most ``k`` neighbours are asked
for, a point needs only its ``k + 1`` smallest ids.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component take no part, neither as queries nor as candidates; vectors of another
dimension are no candidates; repeated rows (same id) are one candidate; ties go
to the smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stage


@dataclass(frozen=True)
class Params:
    """Points of a shard, edges of a point, beam widths of building and searching, pruning factor, batch, query block."""

    shard_rows: int = 4096
    edges: int = 32
    build_beam: int = 64
    search_beam: int = 320
    alpha: float = 1.2
    batch: int = 256
    query_block: int = 4096
    seed: int = 5


def _distances(points: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors, row by row."""
    return 2.0 - 2.0 * np.matmul(points[ids], queries[:, :, None])[:, :, 0]


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int,
                width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the beam of each query, nearest first; -1 where the beam is not full.

    In each step every query expands the ``width`` nearest points of its beam
    that it has not expanded yet.
    """
    n, q = len(points), len(queries)
    line = np.arange(q)[:, None]
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    opened = np.ones((q, beam), bool)
    ids[:, 0], opened[:, 0] = start, False
    dist[:, 0] = _distances(points, ids[:, :1], queries)[:, 0]
    seen = np.zeros((q, n + 1), bool)
    seen[:, start] = True
    while not opened.all():
        nearest = np.argsort(np.where(opened, np.inf, dist), axis=1)[:, :width]
        fresh = ~opened[line, nearest]
        opened[line, nearest] = True
        found = np.where(fresh[:, :, None], graph[np.clip(ids[line, nearest], 0, n - 1)], n).reshape(q, -1)
        found = np.where(found < 0, n, found)  # n: no point
        found.sort(axis=1)
        again = seen[line, found]
        again[:, 1:] |= found[:, 1:] == found[:, :-1]
        again |= found == n
        seen[line, found] = True
        away = _distances(points, np.where(again, 0, found), queries).astype(np.float32)
        away[again] = np.inf
        all_ids, all_dist = np.hstack([ids, found]), np.hstack([dist, away])
        all_opened = np.hstack([opened, again])
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        ids, dist, opened = all_ids[line, best], all_dist[line, best], all_opened[line, best]
        opened |= ~np.isfinite(dist)
    order = np.argsort(dist, axis=1)
    ids, dist = ids[line, order], dist[line, order]
    return np.where(np.isfinite(dist), ids, -1), dist


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, edges: int, alpha: float) -> np.ndarray:
    """Up to ``edges`` diverse neighbours for each node out of its row of candidates (-1: none)."""
    line = np.arange(len(nodes))[:, None]
    candidates = np.sort(candidates, axis=1)
    gone = (candidates < 0) | (candidates == nodes[:, None])
    gone[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    own = points[np.maximum(candidates, 0)]
    dist = 2.0 - 2.0 * np.matmul(own, points[nodes][:, :, None])[:, :, 0]
    dist[gone] = np.inf
    order = np.argsort(dist, axis=1)
    candidates, dist, own = candidates[line, order], dist[line, order], own[line, order]
    between = 2.0 - 2.0 * np.matmul(own, own.transpose(0, 2, 1))
    alive = np.isfinite(dist)
    kept = np.full((len(nodes), edges), -1, np.int64)
    each = np.arange(len(nodes))
    for k in range(edges):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        kept[some, k] = candidates[each, first][some]
        # squared distances, so the factor counts twice
        alive &= ~((alpha * alpha * between[each, first] <= dist) & some[:, None])
        alive[each, first] = False
    return kept


def build_graph(points: np.ndarray, p: Params) -> tuple[np.ndarray, int]:
    """(neighbours of each point, start point) of unit vectors."""
    n = len(points)
    rng = np.random.default_rng(p.seed)
    start = int(np.argmax(points @ points.mean(axis=0)))
    degree = min(p.edges, max(n - 1, 1))
    graph = np.full((n, p.edges), -1, np.int64)
    graph[:, :degree] = rng.integers(0, n, (n, degree))
    for alpha in (1.0, p.alpha):
        order = rng.permutation(n)
        for at in range(0, n, p.batch):
            nodes = order[at:at + p.batch]
            near, _ = beam_search(points, graph, start, points[nodes], p.build_beam)
            graph[nodes] = robust_prune(points, nodes, np.hstack([near, graph[nodes]]), p.edges, alpha)
            source = np.repeat(nodes, p.edges)
            target = graph[nodes].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            ends, first, count = np.unique(target, return_index=True, return_counts=True)
            for lo in range(0, int(count.max(initial=0)), p.edges):  # reverse edges, some for each point at a time
                left = np.minimum(count - lo, p.edges)
                some = left > 0
                more = np.full((int(some.sum()), p.edges), -1, np.int64)
                slots = np.arange(p.edges)[None, :] < left[some][:, None]
                more[slots] = source[(first[some][:, None] + lo + np.arange(p.edges)[None, :])[slots]]
                for part in range(0, len(more), p.batch):
                    rows = ends[some][part:part + p.batch]
                    graph[rows] = robust_prune(points, rows, np.hstack([graph[rows], more[part:part + p.batch]]),
                                               p.edges, alpha)
    return graph, start


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision, also of very large or small ones."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision."""
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    fine = (F.col("vector").isNotNull() & (F.size("vector") > 0) & F.col("id").isNotNull()
            & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("vector", lambda x: x != 0))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(fine)


def build_index(rows: DataFrame, k: int, p: Params) -> DataFrame:
    """One row per shard, stored in the shared folder: shard, dims, members of each point, vectors, graph, start."""
    first = Window.partitionBy("vector").orderBy("id")
    points = (rows.dropDuplicates(["id", "vector"]).withColumn("place", F.row_number().over(first))
              .where(F.col("place") <= k + 1)
              .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members")))
    points = stage(points.select("vector", "members", F.size("vector").alias("dims")), "points")
    n = max(1, -(-points.count() // p.shard_rows))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64(F.col("members")[0]), F.lit(n)))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("members", key=lambda s: s.str[0])
        vectors = np.stack(frame["vector"].to_list()).astype(np.float64)
        graph, start = build_graph(_unit(vectors), p)
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "dims": [vectors.shape[1]],
                             "members": [[list(m) for m in frame["members"]]], "vectors": [vectors.tobytes()],
                             "graph": [graph.astype(np.int32).tobytes()], "start": [start]})

    return stage(dealt.groupBy("shard", "dims").applyInPandas(
        build, "shard long, dims int, members array<array<bigint>>, vectors binary, graph binary, start int"), "index")


def _search(found: pd.Series, ids: np.ndarray, queries: np.ndarray, k: int, p: Params) -> pd.DataFrame:
    """The ``k`` nearest of one shard for each query."""
    vectors = np.frombuffer(found["vectors"]).reshape(-1, found["dims"])
    graph = np.frombuffer(found["graph"], np.int32).reshape(len(vectors), -1)
    members, out = found["members"], []
    unit = _unit(vectors)
    least = np.array([m[0] for m in members], np.int64)
    for at in range(0, len(ids), p.batch):
        part = queries[at:at + p.batch]
        near, _ = beam_search(unit, graph, found["start"], _unit(part), p.search_beam)
        score = np.where(near < 0, -np.inf, cosines(vectors[np.maximum(near, 0)], part[:, None, :]))
        # single precision does not tell near points apart, so all of the beam is compared; one may be the query
        best = np.lexsort((least[near], -score), axis=1)[:, :k + 1]
        near, score = np.take_along_axis(near, best, axis=1), np.take_along_axis(score, best, axis=1)
        for q, places, scores in zip(ids[at:at + p.batch], near, score):
            each = [(-s, int(m), int(q)) for s, c in zip(scores, places) if c >= 0 for m in members[c] if m != q]
            out += sorted(each)[:k]
    return pd.DataFrame({"query_id": [q for _, _, q in out], "vec_id": [m for _, m, _ in out],
                         "score": [-s for s, _, _ in out]})


def nearest(index: DataFrame, queries: DataFrame, k: int, p: Params = Params()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest that the shards' beam searches find for each query (id, vector).

    Queries travel in blocks, each to every shard of its dimension.
    """
    queries = queries.dropDuplicates(["id"])
    blocks = max(1, -(-queries.count() // p.query_block))
    # a row per shard, without the blobs
    shards = F.broadcast(index.select(F.col("shard").alias("to_shard"), F.col("dims").alias("to_dims")))
    dealt = (queries.join(shards, F.size("vector") == F.col("to_dims"))
             .withColumn("to_block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))))
    each = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if shard.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        asked = asked.sort_values("id")
        return _search(shard.iloc[0], asked["id"].to_numpy(np.int64),
                       np.stack(asked["vector"].to_list()).astype(np.float64), k, p)

    found = each.groupBy("shard", "dims", "block").cogroup(dealt.groupBy("to_shard", "to_dims", "to_block")).applyInPandas(
        search, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
           params: Params = Params()) -> DataFrame:
    """Index every usable row and search it for the rows that fulfil ``is_query`` (a condition on ``id``)."""
    rows = usable(vectors, id_col, vector_col)
    return nearest(build_index(rows, k, params), rows.where(is_query), k, params)
