"""Centroid clustering by a tournament of bisectors, in exact integers.

Between two centroids a and b (a the smaller number) lies a bisector: with the integer normal 2 (b - a) and the threshold
|b|^2 - |a|^2, a vector x is nearer to b exactly if normal . x > threshold; zero favours a. Normals and thresholds of all
pairs are computed once. A vector starts with centroid 0 and meets the others in turn, k - 1 linear tests; each eliminates one
centroid, and the distance is computed for the last one left only. The vectors never move: tasks send sums for each cluster.

Vectors that are null, hold null or non-finite entries or have another number of components than asked are left out. Equal
vectors fall in the same cluster; equal centroids are told apart by number, so the later one stays empty. Rows with a null id
take part, and start a cluster only if there are too few others. With fewer vectors than ``k`` there are as many centroids as
vectors; without any the result is empty. Components of any size are exact; distances and sums beyond a long are given as the
largest long. Extra columns play no part. A task holds the normals of all pairs: ``k * k * dims`` integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulseloom.llm.common import stored
from pulseloom.llm.vectors import exact_sums, integers, limbs_of, rows_of, usable

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, "1"
LONGEST = (1 << 63) - 1


def bisectors(centroids: list[list[int]], wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """``normals[a, b]`` and ``thresholds[a, b]`` of the bisector between each two centroids."""
    c = np.array(centroids, object if wide else np.int64)
    length = (c * c).sum(axis=1)
    return 2 * (c[None, :, :] - c[:, None, :]), length[None, :] - length[:, None]


def tournament(x: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each row of ``x``; of equally near ones the smallest."""
    winner = np.zeros(len(x), np.int64)
    for rival in range(1, len(thresholds)):
        side = (x * normals[winner, rival]).sum(axis=1) - thresholds[winner, rival]
        winner[(side > 0).astype(bool)] = rival
    return winner


def first_centroids(rows: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    """The vectors of the ``k`` smallest SHA-256 of ``seed:id``, in that order; null ids last, equal ids by their vectors."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(order.alias("h"), "vec").orderBy(F.col("h").asc_nulls_last(), "vec").limit(k).collect()
    return [integers(np.array([r["vec"]], np.float64), scale)[0].tolist() for r in first]


def bisector_clusters(vectors: DataFrame, *, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
                      seed: str = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that counts.

    ``distance`` is the squared one in the integer space ``floor(scale * x)``; ``centroid_sha256`` digests the final centroid's
    components as decimal integers joined by commas.
    """
    given = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    rows = stored(given.filter(usable(F.col("vec")) & (F.size("vec") == dims)), "vectors")
    limbs = limbs_of(rows, "vec", scale)
    centroids = first_centroids(rows, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        normals, thresholds = bisectors(centroids, limbs > 1)
        met = exact_sums(rows, dims, limbs, lambda x, n=normals, t=thresholds: tournament(x, n, t), scale)
        for cluster, (n, sums) in met.items():
            centroids[cluster] = [s // n for s in sums]
    place = np.array(centroids, object if limbs > 1 else np.int64).reshape(len(centroids), dims)
    normals, thresholds = bisectors(centroids, limbs > 1) if centroids else (None, None)

    def assign(batches):
        for part, x in rows_of(batches, dims):
            x = integers(x, scale)
            winner = tournament(x, normals, thresholds)
            distance = ((x - place[winner]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(winner.astype(np.int32)), pa.array([min(d, LONGEST) for d in distance.tolist()], pa.int64())],
                names=["id", "cluster", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    assigned = stored(rows.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    table = [(c, min(d, LONGEST), digest[c]) for c, d in sums.items()]
    named = vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select(  # one row for each centroid
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia",
        F.lit(min(sum(sums.values()), LONGEST)).cast("long").alias("inertia"), "centroid_sha256")
