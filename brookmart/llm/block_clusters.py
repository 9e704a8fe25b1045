"""Centroid clustering of integer vectors with block-norm screening.

A vector is kept twice: exactly, as integers, and compressed, as small codes of each segment. The norms of its segments'
residuals (what the codes leave out) are computed once. By the inequality of Cauchy and Schwarz the inner product of a
vector and a centroid is within (norm of the vector's residual) x (norm of the centroid) of that of the codes, segment by
segment; this bounds every squared distance from below and above. Only centroids whose lower bound does not exceed the
least upper bound get exact integer distances. Each round's tasks return sums a centroid, which are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Components of a segment, and the largest code: a component is a code times its segment's step.
SEGMENT, CODE = 8, 63
#: Components beyond this (after scaling) are an error: squared distances and sums must fit in 63 bits.
LARGEST = 1 << 26
#: Vectors that are screened together.
TOGETHER = 4096


def compress(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, each segment's step, and the norm of each segment's residual (rounded up) of integer vectors."""
    n, dims = x.shape
    wide = np.pad(x, ((0, 0), (0, -dims % SEGMENT))).reshape(n, -1, SEGMENT).astype(np.float64)
    step = np.maximum(np.abs(wide).max(2) / CODE, 1e-300)
    codes = np.rint(wide / step[:, :, None])
    rest = np.sqrt(((wide - codes * step[:, :, None]) ** 2).sum(2)) * (1 + 1e-9)
    return codes.astype(np.int8).reshape(n, -1), step, rest


class Screen:
    """Centroids with what is computed for them once a round."""

    def __init__(self, centroids: np.ndarray):
        self.exact = centroids.astype(np.int64)
        self.wide = np.pad(self.exact, ((0, 0), (0, -self.exact.shape[1] % SEGMENT))).astype(np.float64)
        self.norms = np.sqrt((self.wide.reshape(len(centroids), -1, SEGMENT) ** 2).sum(2)) * (1 + 1e-9)
        self.square = (self.exact**2).sum(1).astype(np.float64)

    def bounds(self, codes: np.ndarray, step: np.ndarray, rest: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of compressed vectors to all centroids."""
        near = codes.reshape(len(codes), -1, SEGMENT) * step[:, :, None]
        middle = square[:, None] + self.square[None, :] - 2 * (near.reshape(len(codes), -1) @ self.wide.T)
        slack = 2 * (rest @ self.norms.T) + 1e-9 * (square[:, None] + self.square[None, :]) + 1e-6  # and of sums in floating point
        return middle - slack, middle + slack

    def nearest(self, x: np.ndarray, codes: np.ndarray, step: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector, the least number of equals, its exact squared distance, and how many
        distances were computed."""
        lower, upper = self.bounds(codes, step, rest, (x**2).sum(1).astype(np.float64))
        row, column = np.nonzero(lower <= upper.min(1)[:, None])  # by row, so that a row's centroids ascend
        distance = ((x[row] - self.exact[column]) ** 2).sum(1)
        order = np.lexsort((column, distance, row))
        first = order[np.searchsorted(row, np.arange(len(x)))]  # every row has one that is not pruned
        return column[first], distance[first], len(row)


def seeds(kept: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The vectors whose keys' hashes are least; of equal ones, those with the lesser components."""
    drawn = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    return [list(r.x) for r in kept.filter("id is not null").select(drawn.alias("h"), "x").orderBy("h", "x").limit(k).collect()]


def sound(vector: Column, dims: int) -> Column:
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def matrix(lists: pa.Array, kind: type = np.int64) -> np.ndarray:
    return lists.flatten().to_numpy().astype(kind).reshape(len(lists), -1)


def lists(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 256, salt: str = "2") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector with exactly `dims` components.

    Components become floor(scale x component). Centroids start as the k vectors with the least sha256 of 'salt:key'; each
    round assigns every vector to the nearest (squared Euclidean distance, ties to the smaller number) and moves each
    centroid that has vectors to the componentwise floor of their mean. Then vectors are assigned once more.

    Vectors that are null, of another length or hold null or non-finite components are left out; rows without a key are
    clustered but are no seeds; rows that repeat a key are vectors of their own. With fewer than k vectors there are fewer
    centroids; an empty table, or one without a key, gives no rows. Components beyond 2^26 after scaling are an error.
    Other columns are not read. The driver holds the centroids, and sums of k x dims numbers.
    """
    tmp = Scratch()
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(sound(F.col("v"), dims))
    scaled = rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("x"), F.transform("v", lambda x: x * scale).alias("_y"))
    large = F.exists("_y", lambda y: F.abs(y) >= LARGEST)
    whole = scaled.select("id", F.when(large, F.raise_error(F.lit("components are too large: a distance may not fit in 63 bits"))).otherwise(F.col("x").cast("array<int>")).alias("x"))

    def compressed(batches):
        for batch in batches:
            codes, step, rest = compress(matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array([c.tobytes() for c in codes], pa.binary()), lists(step), lists(rest)], ["id", "x", "codes", "step", "rest"])

    kept = tmp.saved(whole.mapInArrow(compressed, "id long, x array<int>, codes binary, step array<double>, rest array<double>"), "vectors")
    centroids = seeds(kept, k, salt)
    if not centroids:
        return kept.limit(0).select(F.col("id").alias(key), F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))

    def assigned(batches, screen: Screen):
        """Batches with each vector's nearest centroid and distance."""
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.int8).reshape(batch.num_rows, -1)
                x = matrix(batch.column("x"))
                yield batch, x, *screen.nearest(x, codes, matrix(batch.column("step"), np.float64), matrix(batch.column("rest"), np.float64))[:2]

    for _ in range(rounds):
        screen = Screen(np.asarray(centroids, np.int64))

        def partial(batches, screen=screen):
            """Sums and counts of a task's vectors, a row for each of its centroids."""
            n = len(screen.exact)
            sums, counts = np.zeros((n, dims), np.int64), np.zeros(n, np.int64)
            for _, x, cluster, _ in assigned(batches, screen):
                member = (cluster[:, None] == np.arange(n)).astype(np.float64)
                sums += (member.T @ x.astype(np.float64)).astype(np.int64)  # exact: below 2^38
                counts += np.bincount(cluster, minlength=n)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), lists(sums[used])], ["cluster", "n", "sums"])

        parts = kept.mapInArrow(partial, "cluster int, n long, sums array<long>")
        total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)))
        for r in total.collect():  # k rows at most
            centroids[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]

    screen = Screen(np.asarray(centroids, np.int64))

    def final(batches):
        for batch, _, cluster, distance in assigned(batches, screen):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    out = tmp.saved(kept.mapInArrow(final, "id long, cluster int, distance long"), "clusters")
    sums = {r.cluster: r.d for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    tmp.discard(out)
    named = [(i, sums[i], sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids) if i in sums]
    each = kept.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(each), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2", vectors: str = "embeddings") -> str:
    """The same over `vectors` (vec_id, embedding), whose keys are distinct, in DuckDB's SQL."""
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS x FROM {vectors}
  WHERE len(embedding) = {dims} AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('{salt}:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h LIMIT {k}))"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, x, best.c AS c, best.d AS d FROM (
  SELECT v.vec_id, any_value(v.x) AS x, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), c := c.c)) AS best FROM v, c{i} c GROUP BY v.vec_id))""")
        if i < rounds:
            parts.append(f"""m{i} AS (SELECT c, list(m ORDER BY i) AS x FROM (SELECT c, i, CAST(floor_div(s, n) AS BIGINT) AS m FROM (
  SELECT c, i, sum(y) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY c, i)) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))""".replace("floor_div(s, n)", "(s - ((s % n) + n) % n) // n"))
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""
