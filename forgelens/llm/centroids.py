"""Centroid clustering in whole numbers, with Ptolemaic lower bounds.

For any points x, c and pivots p, q: |d(x,p) d(c,q) - d(x,q) d(c,p)| <= d(x,c) d(p,q).
The distances of all vectors to a few fixed pivots are worked out once and written with
the vectors; in each round a centroid is compared with a vector only if no pivot pair
shows that it is farther than the best one so far.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import save
from .vectors import Sums, floors_of_means, long_or_null, matrix, usable, whole

PIVOTS = 6
#: Relative slack of the bounds, far above the rounding of the few operations behind them.
SLACK = 2.0**-40


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows to a point, or to as many points."""
    gap = rows - point
    return np.einsum("ij,ij->i", gap, gap)


def choose_pivots(points: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Up to ``most`` different points, each the farthest from those before; the first is the first."""
    if not len(points):
        return points
    chosen = [0]
    nearest = squared(points, points[0])
    while len(chosen) < most and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(points, points[chosen[-1]]))
    return points[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(rows), len(pivots)))
    for i, pivot in enumerate(pivots):
        out[:, i] = np.sqrt(squared(rows, pivot).astype(np.float64))
    return out


class Assigner:
    """Nearest of some centroids, smaller number first, for rows with cached pivot distances."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids = centroids
        self.to_pivots = distances(centroids, pivots)
        between = distances(pivots, pivots)
        self.pairs = [
            (p, q, between[p, q]) for p in range(len(pivots)) for q in range(p) if between[p, q] > 0
        ]

    def bounds(self, cached: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of every row to every centroid, rounded down."""
        least = np.zeros((len(cached), len(self.centroids)))
        for p, q, apart in self.pairs:
            one = np.outer(cached[:, p], self.to_pivots[:, q])
            two = np.outer(cached[:, q], self.to_pivots[:, p])
            np.maximum(least, (np.abs(one - two) - SLACK * (one + two)) * ((1 - SLACK) / apart), out=least)
        return least

    def nearest(self, rows: np.ndarray, cached: np.ndarray):
        """(number, squared distance, distances worked out) of the nearest centroid of each row."""
        least = self.bounds(cached)
        label = least.argmin(axis=1)
        first = label.copy()
        best = squared(rows, self.centroids[label])
        checked = np.ones(len(rows), np.int64)
        least *= least * (1 - SLACK)
        for number, centroid in enumerate(self.centroids):
            # a bound equal to the best distance may be a tie, so only a larger one excludes
            left = np.flatnonzero((least[:, number] <= best * (1 + SLACK)) & (first != number))
            found = squared(rows[left], centroid)
            closer = (found < best[left]) | ((found == best[left]) & (number < label[left]))
            checked[left] += 1
            left = left[closer]
            best[left] = found[closer]
            label[left] = number
        return label, best, checked


def cluster_vectors(
    rows: DataFrame,
    k: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: int = 64,
    seed: str = "1:",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, checked) of every kept vector.

    Kept are vectors of ``dims`` components, all there and finite; each component x counts
    as floor(scale * x).  Centroids start as the k vectors with the smallest sha256 of the
    seed and their id (equal ids: the smaller vector first; null ids last), in that order.
    Each round assigns every vector to its nearest centroid, ties to the smaller number,
    and moves each centroid that has vectors to the exact floor of their mean; then they
    are assigned once more.  With fewer than k vectors there are fewer centroids; without
    any, no rows.  Repeated rows count as often as they stand there.  Components beyond
    2^27 either way count as that; a sum beyond a long is null.

    ``distance`` is squared, ``checked`` the number of distances that the pivots left to
    work out.  Vectors and their pivot distances are written once; a round sends one sum
    per cluster, component and task, and the driver holds k centroids.
    """
    vector = F.col(vector_col)
    kept = rows.where(usable(vector) & (F.size(vector) == dims)).select(
        F.col(id_col).alias("_id"), whole(vector, scale).alias("_v")
    )
    name = F.sha2(F.concat(F.lit(seed), F.col("_id").cast("string")), 256)
    start = kept.orderBy(name.asc_nulls_last(), "_v").limit(k).select("_v").collect()
    centroids = np.array([r["_v"] for r in start], np.int64).reshape(-1, dims)
    fixed = choose_pivots(centroids, pivots)

    def with_distances(batches):
        for batch in batches:
            found = distances(matrix(batch.column(1), dims).astype(np.int64), fixed)
            flat = pa.array(found.reshape(-1), pa.float64())
            offsets = pa.array(np.arange(len(found) + 1) * len(fixed), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, flat)], ["_id", "_v", "_d"]
            )

    schema = T.StructType([*kept.schema.fields, T.StructField("_d", T.ArrayType(T.DoubleType()))])
    cached = save(kept.mapInArrow(with_distances, schema), "pivot-distances")

    def parts(batch, assigner):
        points = matrix(batch.column("_v"), dims).astype(np.int64)
        return points, assigner.nearest(points, matrix(batch.column("_d"), len(fixed)))

    for _ in range(rounds if len(centroids) else 0):

        def summed(batches, centroids=centroids):
            assigner, sums = Assigner(centroids, fixed), Sums(len(centroids), dims)
            for batch in batches:
                points, (label, _, _) = parts(batch, assigner)
                sums.add(label, points)
            yield sums.batch()

        centroids = floors_of_means(cached.mapInArrow(summed, Sums.SCHEMA), centroids)

    final = centroids

    def assigned(batches):
        assigner = Assigner(final, fixed)
        for batch in batches:
            _, (label, best, checked) = parts(batch, assigner)
            columns = [pa.array(label, pa.int32()), pa.array(best), pa.array(checked)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], ["_id", "cluster", "distance", "checked"])

    schema = T.StructType(
        [kept.schema.fields[0], T.StructField("cluster", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("distance", "checked")]
    )
    found = save(cached.mapInArrow(assigned, schema), "clusters")
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    totals = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(total).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    own = [(c, long_or_null(t), long_or_null(sum(totals.values())), shas[c]) for c, t in sorted(totals.items())]
    clusters = rows.sparkSession.createDataFrame(
        own, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    # at most k rows
    return found.join(F.broadcast(clusters), "cluster").select(
        F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "checked"
    )
