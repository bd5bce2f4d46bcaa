"""Centroid clustering; nearest centroids by the threshold algorithm.

Every dimension has the list of its centroids sorted by their component there.  A vector
finds its place in every list and walks outward from it, nearer side first, one entry of
every list a step.  A centroid met for the first time gets its exact distance.  The
frontier of a list is the gap between the vector's component and the entry just read; a
centroid not met yet is at least that far away in every dimension, so the walk stops as
soon as the sum of the squared frontiers strictly exceeds the best exact distance (at
equality a centroid of a smaller number could still tie).

Vectors stay where they are read: a round sends the sums of each task alone, and the
centroids (``k`` times the dimensions) are all that the driver holds.

Defined results.  A vector that is null, has another number of components than ``dims``, or
holds a null, NaN, infinite or (scaled) greater component than ``wholevectors.LIMIT`` is left out.
Repeated rows count each; starts of equal hash are ordered by their components.  A null
vec_id is clustered like others and comes last among the starts.  Fewer rows than ``k``: so many clusters.  An empty table
gives no rows.  Sums beyond a long are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, empty_like
from .wholevectors import MAX_LONG, matrix, means, numbers_sha256, scaled, squared

SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
#: Vectors that walk at a time.
WALK = 1024
FAR = np.int64(1) << 40


class Lists:
    """The sorted list of every dimension, with a far entry at both ends."""

    def __init__(self, centroids: np.ndarray) -> None:
        k, d = centroids.shape
        self.centroids = centroids
        self.number = np.argsort(centroids, axis=0, kind="stable")
        self.value = np.full((k + 2, d), FAR)
        self.value[0] = -FAR
        self.value[1:-1] = np.take_along_axis(centroids, self.number, 0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of every row; ties to the smaller number."""
        parts = [self._walk(x[at:at + WALK]) for at in range(0, len(x), WALK)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (n, d), k = x.shape, len(self.centroids)
        best, found = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        right = np.stack([np.searchsorted(self.value[1:-1, j], x[:, j]) for j in range(d)], 1) + 1
        left = right - 1
        met = np.zeros((n, k), bool)
        walking, column = np.arange(n), np.arange(d)
        for _ in range(k):
            at, l, r = x[walking], left[walking], right[walking]
            gap_l, gap_r = at - self.value[l, column], self.value[r, column] - at
            to_left = gap_l <= gap_r
            read = np.where(to_left, l, r)
            left[walking], right[walking] = l - to_left, r + ~to_left
            new = np.zeros((len(walking), k), bool)
            new[np.arange(len(walking))[:, None], self.number[read - 1, column]] = True
            new &= ~met[walking]
            met[walking] |= new
            row, number = np.nonzero(new)
            row = walking[row]
            distance = squared(x[row], self.centroids[number])
            # numbers rise within a row, so later ones don't displace equal ones
            order = np.lexsort((number, distance, row))
            first = order[np.r_[True, row[order][1:] != row[order][:-1]]] if len(order) else order
            r0, d0, n0 = row[first], distance[first], number[first]
            better = (d0 < best[r0]) | ((d0 == best[r0]) & (n0 < found[r0]))
            best[r0[better]], found[r0[better]] = d0[better], n0[better]
            frontier = (np.minimum(gap_l, gap_r) ** 2).sum(1)
            walking = walking[~(frontier > best[walking])]
            if not len(walking):
                break
        return found, best


def starts(rows: DataFrame, k: int) -> np.ndarray:
    """The vectors of the k least hashes of ``1:<vec_id>``, in that order."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(k)
    return np.array([r["x"] for r in first.collect()], np.int64)


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` per kept row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = scaled(vectors.where(F.size("embedding") == dims), scale, "vec_id").select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    centroids = starts(rows, k)
    if not len(centroids):
        return empty_like(spark, SCHEMA)
    for _ in range(rounds):
        lists = Lists(centroids)
        centroids = means(rows, centroids, lambda x, lists=lists: (lists.nearest(x)[0], x))
    lists = Lists(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, distance = lists.nearest(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(number, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = cut(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    # one row per cluster
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda s: s if s <= MAX_LONG else None
    total = fits(sum(sums.values()))
    table = spark.createDataFrame([(c, fits(s), total, numbers_sha256(centroids[c].tolist())) for c, s in sums.items()],
                                  "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), F.col("cluster") == F.col("c")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _rounds(last: int) -> str:
    """Assignments a0 to a<last> of vectors v (r, e) to centroids c0 to c<last> (k, e), each from the one before."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))"
    steps = []
    for i in range(last + 1):
        if i:
            steps.append(f"""m{i} AS (SELECT cluster AS k, i, sum(x) AS s, count(*) AS n FROM (
  SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{i - 1}) GROUP BY cluster, i
), c{i} AS (SELECT c.k, coalesce(new.e, c.e) AS e FROM c{i - 1} c LEFT JOIN (
  SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM m{i} GROUP BY k) new ON c.k = new.k
)""")
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(e) AS e, min(near).k AS cluster, min(near).d AS distance FROM (
  SELECT v.r, v.vec_id, v.e, {{'d': CAST({square} AS BIGINT), 'k': c.k}} AS near FROM v CROSS JOIN c{i} c) GROUP BY r)""")
    return ",\n".join(steps)


ORACLE_OP11 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS k, e FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) <= 16
), {_rounds(3)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.e, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON a3.cluster = c3.k
"""
