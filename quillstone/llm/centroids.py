"""Centroid clustering of integer vectors with block-norm screening.

Vectors and centroids are compressed to each segment's mean and the norm of what deviates from it. By Cauchy and Schwarz no inner product of deviations is larger than the product of their
norms, so the squared distance is at least the sum over segments of (difference of means)^2 times the width plus (difference of norms)^2. A vector meets the centroids in the order of these bounds, and
exact integer distances are computed only while the next bound isn't above the least distance found. Vectors are compressed once and kept so; a round is
one pass over that table, whose tasks return integer sums of each cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

DIM, SEGMENT, SCALE = 64, 2, 256
#: Largest component that is clustered, as an integer: squared distances of such vectors fit a long.
LARGEST = 1 << 27
#: Vectors that meet the centroids at once.
BLOCK = 1024


def compressed(x: np.ndarray) -> np.ndarray:
    """Each row's segment means, times the root of the width, and norms of deviations: the squared distance of two such rows bounds that of the vectors from below."""
    parts = x.reshape(len(x), DIM // SEGMENT, SEGMENT).astype(float)
    mean = parts.mean(axis=2)
    return np.hstack([mean * np.sqrt(SEGMENT), np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2))])


def nearest(x: np.ndarray, short: np.ndarray, centroids: np.ndarray, short_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, squared distance, exact distances computed) of each vector's nearest centroid, the smallest number of equals."""
    squares = (short * short).sum(axis=1)[:, None] + (short_centroids * short_centroids).sum(axis=1)
    bound = squares - 2 * (short @ short_centroids.T) - 1e-9 * squares - 1e-6  # less what rounding can add
    order = np.argsort(bound, axis=1, kind="stable")
    best, at, met = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(centroids)), np.zeros(len(x), np.int32)
    active = np.arange(len(x))
    for k in range(len(centroids)):
        c = order[active, k]
        go = bound[active, c] <= best[active]
        active, c = active[go], c[go]
        if not len(active):
            break
        d = x[active] - centroids[c]
        exact = (d * d).sum(axis=1)
        nearer = (exact < best[active]) | ((exact == best[active]) & (c < at[active]))
        best[active[nearer]], at[active[nearer]] = exact[nearer], c[nearer]
        met[active] += 1
    return at, best, met


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x, short): vectors of exactly DIM components, none null or non-finite, as floor(SCALE * component), and compressed.

    Components whose integer is beyond LARGEST count as non-finite, as distances wouldn't fit a long.
    """
    v = F.col(f"`{vec_col}`").cast("array<double>")
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST / SCALE))
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("int"))
    kept = vectors.where(v.isNotNull() & (F.size(v) == DIM) & F.coalesce(fits, F.lit(False))).select(F.col(f"`{id_col}`").alias("vec_id"), x.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = compressed(_matrix(b.column(1)))
            short = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), short], names=["vec_id", "x", "short"])

    return kept.mapInArrow(run, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, x array<int>, short array<double>")


def _matrix(column: pa.Array, width: int = DIM) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (flat.astype(np.int64) if pa.types.is_integer(column.type.value_type) else flat).reshape(len(column), width)


def _met(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, tuple]]:
    c = np.array(centroids, np.int64)
    short = compressed(c)
    for big in batches:
        for k in range(0, big.num_rows, BLOCK):
            b = big.slice(k, BLOCK)
            x = _matrix(b.column("x"))
            yield b, x, nearest(x, _matrix(b.column("short"), 2 * DIM // SEGMENT), c, short)


def moved(table: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: componentwise floor of their vectors' means; those without vectors stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), DIM), np.int64), np.zeros(len(centroids), np.int64)
        for _, x, (at, _, _) in _met(batches, centroids):
            np.add.at(sums, at, x)
            counts += np.bincount(at, minlength=len(centroids))
        of = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(counts[of]), pa.array(list(sums[of]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = table.select("x", "short").mapInArrow(run, "cluster int, n long, sums array<long>")
    parts = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    totals = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a number for each component of each centroid
    new = [list(c) for c in centroids]
    for r in totals:
        new[r["cluster"]][r["i"]] = int(r["s"]) // r["n"]
    return new


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_exact) of every kept vector.

    Centroids start as the k vectors whose `seed:vec_id` has the least sha256. n_exact counts the exact distances that screening left in the last assignment. Null, short, long and
    non-finite vectors have no row; vectors of null id are assigned but start no centroid; rows that repeat an id or a vector each have a row,
    and of an id's rows the least vector comes first among the starts. Fewer vectors with ids than k: as many centroids; none: no rows. Ties go to the smaller number.
    """
    spark = vectors.sparkSession
    table = written(integer_vectors(vectors, id_col, vec_col), "integers")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = table.where(F.col("vec_id").isNotNull()).select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    centroids = [list(r["x"]) for r in first]
    kind = table.schema["vec_id"].dataType.simpleString()
    if not centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_exact int")
    for _ in range(rounds):
        centroids = moved(table, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, (at, best, met) in _met(batches, centroids):
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(best), pa.array(met)], names=["vec_id", "cluster", "distance", "n_exact"])

    found = written(table.mapInArrow(run, f"vec_id {kind}, cluster int, distance long, n_exact int"), "assigned")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(i, inertia[i], sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids) if i in inertia]
    of = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact")  # k rows at most


def _sql(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """clusters() in DuckDB SQL over the table embeddings, a round as two common tables."""
    square = "(sum((t.x - c.x) * (t.x - c.x)))::BIGINT"
    parts = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v::DOUBLE))) = {DIM})",
        "flat AS (SELECT vec_id, unnest(x) AS x, unnest(range(len(x))) AS i FROM kept)",
        f"first AS (SELECT x, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k})",
        "c0 AS (SELECT c, unnest(x) AS x, unnest(range(len(x))) AS i FROM first)",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT t.vec_id, c.c, {square} AS d FROM flat t JOIN c{r} c USING (i) GROUP BY t.vec_id, c.c QUALIFY row_number() OVER (PARTITION BY t.vec_id ORDER BY d, c.c) = 1)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT a.c, t.i, sum(t.x) AS s, count(*) AS n FROM flat t JOIN a{r} a USING (vec_id) GROUP BY a.c, t.i)")
            parts.append(f"c{r + 1} AS (SELECT c.c, c.i, coalesce(((s.s - ((s.s % s.n) + s.n) % s.n) // s.n)::BIGINT, c.x) AS x FROM c{r} c LEFT JOIN s{r} s USING (c, i))")
    parts.append(f"digests AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)")
    return "WITH " + ", ".join(parts) + f" SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN digests USING (c)"


#: Less n_exact, which is about the work, not the result.
SQL = _sql()
