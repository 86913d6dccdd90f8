"""Approximate nearest neighbours by cosine: a robust-pruned directed graph in each shard, and beam search of every shard.

Distinct vectors are dealt into shards by hash. In each, greedy searches from the medoid propose a vector's neighbours, and relaxed
pruning keeps a proposal unless a kept, nearer one is closer to it by the factor ALPHA, so that edges point in diverse directions (Vamana).
A beam search walks each shard's graph for every query; what it finds is ranked by the exact cosine in double precision, and the
shards' lists are merged. Copies of a vector share a node, which carries as many of their smallest ids as a result can hold.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Distinct vectors of a shard; queries searched at once; a node's edges; beam widths of building and of search.
SHARD, BLOCK = 2048, 4096
DEGREE, BUILD_WIDTH, WIDTH, ALPHA = 24, 40, 64, 1.2
BATCH = 256


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unit vectors q: the beams' nodes (-1: none) and distances, and a mask of the nodes that were expanded. Graph rows are padded with len(x)."""
    b, n = len(q), len(x)
    padded = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
    ids, dist, done = np.full((b, width), n), np.full((b, width), np.inf, np.float32), np.zeros((b, width), bool)
    seen, expanded = np.zeros((b, n + 1), bool), np.zeros((b, n + 1), bool)
    seen[:, n] = True
    ids[:, 0], dist[:, 0] = entry, 1 - q @ x[entry]
    seen[:, entry] = True
    while True:
        todo = np.where(done, np.inf, dist)
        k = todo.argmin(axis=1)
        act = np.flatnonzero(np.isfinite(todo[np.arange(b), k]))
        if not len(act):
            return np.where(np.isfinite(dist), ids, -1), dist, expanded[:, :n]
        cur = ids[act, k[act]]
        done[act, k[act]] = True
        expanded[act, cur] = True
        near = graph[cur]
        new = ~seen[act[:, None], near]
        seen[act[:, None], near] = True
        d = np.where(new, 1 - np.einsum("ad,ard->ar", q[act], padded[near], optimize=False), np.inf).astype(np.float32)
        all_d, all_i, all_done = np.hstack([dist[act], d]), np.hstack([ids[act], near]), np.hstack([done[act], np.zeros(near.shape, bool)])
        best = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        rows = np.arange(len(act))[:, None]
        dist[act], ids[act], done[act] = all_d[rows, best], all_i[rows, best], all_done[rows, best]


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
    """DEGREE edges at most for each point from its candidates (rows padded with len(x); a point isn't its own candidate)."""
    n = len(x)
    padded = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
    c = padded[candidates]
    valid = (candidates < n) & (candidates != points[:, None])
    d = np.where(valid, 1 - np.einsum("pd,pcd->pc", x[points], c), np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, : 4 * DEGREE]
    rows = np.arange(len(points))[:, None]
    d, candidates, c = d[rows, order], candidates[rows, order], c[rows, order]
    between = 1 - np.matmul(c, c.transpose(0, 2, 1))
    out = np.full((len(points), DEGREE), n)
    live = np.isfinite(d)
    for k in range(DEGREE):
        first = live.argmax(axis=1)
        has = live[np.arange(len(points)), first]
        if not has.any():
            break
        out[has, k] = candidates[has, first[has]]
        near = between[np.arange(len(points)), first]
        live &= ~((alpha * near <= d) & has[:, None])
        live[has, first[has]] = False
    return out


def build_graph(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, int]:
    """(edges of each node, padded with len(x); the node where searches start) for unit vectors."""
    n, rng = len(x), np.random.default_rng(seed)
    entry = int((x @ x.mean(axis=0)).argmax())
    if n <= DEGREE + 1:
        full = np.array([[j for j in range(n) if j != i] + [n] * (DEGREE + 1 - n) for i in range(n)], int).reshape(n, DEGREE)
        return full, entry
    graph = np.argsort(rng.random((n, min(n, 4 * DEGREE))), axis=1)[:, :DEGREE]
    graph = (graph * (n // (4 * DEGREE) + 1) + rng.integers(n, size=(n, 1)) + 1) % n
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            points = order[k : k + BATCH]
            beam, _, expanded = beam_search(x, graph, x[points], entry, BUILD_WIDTH)
            most = int(expanded.sum(axis=1).max())
            visited = np.argsort(~expanded, axis=1, kind="stable")[:, :most]
            visited = np.where(expanded[np.arange(len(points))[:, None], visited], visited, n)
            beam = np.where((beam >= 0) & ~np.take_along_axis(np.hstack([expanded, np.ones((len(points), 1), bool)]), np.where(beam >= 0, beam, n), axis=1), beam, n)
            own = graph[points]
            own = np.where((own[:, :, None] == np.hstack([visited, beam])[:, None, :]).any(axis=2), n, own)
            graph[points] = robust_prune(x, points, np.hstack([visited, beam, own]), alpha)
            add_reverse(x, graph, points, alpha)
    return graph, entry


def add_reverse(x: np.ndarray, graph: np.ndarray, points: np.ndarray, alpha: float) -> None:
    """Edges back from the points' neighbours; a node with too many is pruned again."""
    n = len(x)
    source, target = np.repeat(points, DEGREE), graph[points].ravel()
    source, target = source[target < n], target[target < n]
    fresh = ~(graph[target] == source[:, None]).any(axis=1)
    source, target = source[fresh], target[fresh]
    if not len(target):
        return
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    wide = np.full((len(nodes), DEGREE + int(count.max())), n)
    wide[:, :DEGREE] = graph[nodes]
    wide[np.repeat(np.arange(len(nodes)), count), DEGREE + np.arange(len(target)) - np.repeat(first, count)] = source
    fits = (wide < n).sum(axis=1) <= DEGREE
    graph[nodes[fits]] = np.sort(wide[fits], axis=1)[:, :DEGREE]
    if not fits.all():
        graph[nodes[~fits]] = robust_prune(x, nodes[~fits], wide[~fits], alpha)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to 0.5 to 1: cosines keep every bit, and no square over- or underflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def unit(v: np.ndarray) -> np.ndarray:
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _index_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["h1", "h2"], kind="stable").reset_index(drop=True)
    graph, entry = build_graph(unit(scaled(np.stack(pdf["v"].to_numpy()).astype(float))))
    edges = [row[row < len(pdf)].astype(np.int32) for row in graph]
    return pdf[["dim", "shard", "v", "ids"]].assign(node=np.arange(len(pdf), dtype=np.int32), edges=edges, entry=np.int32(entry))


def _search_shard(k: int):
    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q1": pd.Series(dtype="int64"), "q2": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if index.empty or queries.empty:
            return empty
        index = index.sort_values("node", kind="stable")
        v = scaled(np.stack(index["v"].to_numpy()).astype(float))
        norm, n = np.linalg.norm(v, axis=1), len(v)
        graph = np.full((n, DEGREE), n)
        for row, e in zip(graph, index["edges"], strict=True):
            row[: len(e)] = e
        x, ids = unit(v), index["ids"].to_numpy()
        out = []
        for at in range(0, len(queries), BATCH):
            part = queries.iloc[at : at + BATCH]
            qs = scaled(np.stack(part["qv"].to_numpy()).astype(float))
            beam, _, _ = beam_search(x, graph, unit(qs), int(index["entry"].iloc[0]), WIDTH)
            for q1, q2, q, nodes in zip(part["q1"], part["q2"], qs, beam, strict=True):
                nodes = nodes[nodes >= 0]
                score = (v[nodes] * q).sum(axis=1) / (norm[nodes] * np.linalg.norm(q))
                flat = sorted(((-s, int(i)) for s, node in zip(score.tolist(), nodes, strict=True) for i in ids[node]))[: k + 1]
                out += [(q1, q2, i, -s) for s, i in flat]
        return pd.DataFrame(out, columns=empty.columns) if out else empty

    return search


def usable(id_col: str, vec_col: str) -> Column:
    """Whether a row takes part: it has an id and a vector of finite components that aren't all zero."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda c: c != 0)


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each row that meets the condition queries.

    Every usable row is indexed. Ties go to the smaller id. Vectors null, empty, zero, or with null or non-finite components take no part,
    nor do rows of null id; vectors of different lengths aren't compared. Rows that repeat id and vector are one row; copies of a vector under
    other ids are candidates. Fewer candidates than k: all of them. An empty table gives an empty table; extra columns aren't read.
    """
    rows = vectors.where(usable(id_col, vec_col)).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("v"), queries.alias("asks"))
    rows = rows.groupBy("id", "v").agg(F.max("asks").alias("asks")).select("id", "v", "asks", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), F.size("v").alias("dim"))
    rows = written(rows, "vectors")
    by_vector = Window.partitionBy("h1", "h2", "dim").orderBy("id")
    first = rows.select("id", "v", "h1", "h2", "dim").withColumn("nth", F.row_number().over(by_vector)).where(F.col("nth") <= k + 1)
    nodes = written(first.groupBy("h1", "h2", "dim").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")), "nodes")
    shards = max(1, math.ceil(nodes.count() / SHARD))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("h1", F.lit("shard")), F.lit(shards)).cast("int"))
    item = rows.schema["v"].dataType.simpleString()
    by_shard = dealt.repartition(shards, "dim", "shard")  # a task for each shard: the work is in the graph, not in the bytes
    index = by_shard.groupBy("dim", "shard").applyInPandas(_index_shard, f"dim int, shard int, v {item}, ids array<long>, node int, edges array<int>, entry int")
    asked = rows.where("asks").select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), "dim", F.col("v").alias("qv"))
    asked = written(asked.dropDuplicates(["q1", "q2", "dim"]), "asked")
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    spread = asked.withColumn("block", F.pmod(F.xxhash64("q1", F.lit("block")), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    copies = index if blocks == 1 else written(index, "index")
    copies = copies.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    found = copies.repartition(shards * blocks, *keys).groupBy(*keys).cogroup(spread.repartition(shards * blocks, *keys).groupBy(*keys)).applyInPandas(_search_shard(k), "q1 long, q2 long, vec_id long, score double")
    top = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k + 1).select("q1", "q2", "vec_id", "score")
    own = rows.where("asks").select(F.col("id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"))
    ranked = Window.partitionBy("query_id", "q1", "q2").orderBy(F.desc("score"), "vec_id")
    result = own.join(found, ["q1", "q2"]).where("vec_id != query_id").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
