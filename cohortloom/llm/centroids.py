"""Centroid clustering of integer vectors: exact Walsh-Hadamard coefficients, compared coarse to fine.

Vectors and centroids are transformed by integers alone, coefficients put in order of sign changes (sequency), so that the first ones hold
the coarse shape. The sum of squared coefficient differences is `dims` times the squared distance, and sums over some coefficients
only bound it from below. For each vector the centroid that leads after the coarsest coefficients is measured in full; another drops out
as soon as its partial sum is strictly larger. Those that are left are summed over all coefficients, so ties are seen exactly.

Vectors are assigned where they are read. A task hands on one partial sum for each cluster, component and part of its digits, whatever its rows; the centroids, the only
thing that reaches the driver, are as many as asked for.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.shared import send_code, staged

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
# Ends of the coefficient blocks that are compared before the next are looked at.
LADDER = (8, 16, 32, 64)
# Components up to this size are handled in 64 bits: 64 coefficients of up to 64 * 2 * LIMIT, squared and summed, stay below 2^63.
LIMIT = 1 << 24
# Sums leave the tasks in digits of this many bits, so that adding those of all tasks is exact whatever the size of the components.
DIGIT = 48


def sequency(dims: int) -> np.ndarray:
    """Places of the coefficients of `transform` by their number of sign changes."""
    rows = transform(np.eye(dims, dtype=np.int64))
    return np.argsort((np.diff(np.sign(rows), axis=1) != 0).sum(axis=1), kind="stable")


def transform(vectors: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row by sums and differences; its length is a power of two. Integers (or Python's, as objects) stay exact."""
    n, dims = vectors.shape
    half = 1
    while half < dims:
        pairs = vectors.reshape(n, dims // (2 * half), 2, half)
        vectors = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, dims)
        half *= 2
    return vectors


def nearest(vectors: np.ndarray, centroids: np.ndarray, ladder: tuple[int, ...] = LADDER) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row: the nearest centroid, on ties the one of the smaller number. Exact."""
    dims = vectors.shape[1]
    most = max((max(abs(int(x.max())), abs(int(x.min()))) for x in (vectors, centroids) if x.size), default=0)
    kind = np.int64 if most <= LIMIT else object
    order = sequency(dims)
    left, right = (transform(x.astype(kind))[:, order] for x in (vectors, centroids))
    coarse = ladder[0]
    sums = np.stack([((left[:, :coarse] - c[:coarse]) ** 2).sum(axis=1) for c in right], axis=1)
    leader = np.argmin(sums, axis=1)
    bound = sums[np.arange(len(left)), leader] + ((left[:, coarse:] - right[leader][:, coarse:]) ** 2).sum(axis=1)
    row, cluster = np.nonzero(sums <= bound[:, None])
    sums = sums[row, cluster]
    for start, end in zip(ladder, ladder[1:]):
        sums = sums + ((left[row, start:end] - right[cluster, start:end]) ** 2).sum(axis=1)
        stay = (sums <= bound[row]).astype(bool)
        row, cluster, sums = row[stay], cluster[stay], sums[stay]
    first = np.searchsorted(row, np.arange(len(left)))
    best = np.minimum.reduceat(sums, first) if len(first) else sums
    at = np.flatnonzero(sums == best[row])
    at = at[np.searchsorted(row[at], np.arange(len(left)))]
    return cluster[at].astype(np.int32), sums[at] // dims


def _kept(embedding: Column, dims: int) -> Column:
    return (F.size(embedding) == dims) & F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)))


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles, as 64-bit integers where all are small, else as Python's."""
    if not vectors.size or np.abs(vectors).max() <= LIMIT / scale:
        return np.floor(scale * vectors).astype(np.int64)
    exact = [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in vectors.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(vectors.shape)


def _read(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """vec_id and integer vectors of the rows that are kept."""
    right = pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), dims), False)
    ids, lists = batch.column("vec_id").filter(right), batch.column("embedding").filter(right)
    values = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    finite = np.isfinite(values).all(axis=1)
    return ids.filter(pa.array(finite)), whole(values[finite], scale)


def _long(values: np.ndarray) -> pa.Array:
    """Longs; null where a number is larger than a long can hold."""
    return pa.array([x if -(2**63) <= x < 2**63 else None for x in values.tolist()], pa.int64())


def first_centroids(rows: DataFrame, clusters: int, dims: int, scale: int) -> list[list[int]]:
    """The kept vectors with the smallest SHA-256 of `1:<vec_id>`, in that order (equal ids: by their components)."""
    name = F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = rows.where(_kept(F.col("embedding"), dims)).select(F.sha2(name, 256).alias("hash"), "embedding").orderBy("hash", "embedding").limit(clusters).collect()
    return whole(np.array([r.embedding for r in first], np.float64).reshape(-1, dims), scale).tolist()


def _matrix(centroids: list[list[int]]) -> np.ndarray:
    big = max(abs(x) for c in centroids for x in c) > LIMIT
    return np.array(centroids, object if big else np.int64)


def assigned(rows: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance of each kept vector."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = _matrix(centroids)
        for batch in batches:
            ids, vectors = _read(batch, matrix.shape[1], scale)
            if len(vectors):
                cluster, distance = nearest(vectors, matrix)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), _long(distance)], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(assign, "vec_id long, cluster int, distance long")


def _digits(value: int) -> Iterator[tuple[int, int]]:
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield place, sign * (value & ((1 << DIGIT) - 1))
        value >>= DIGIT
        place += 1


def moved(rows: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> list[list[int]]:
    """Centroids after one round: the floored means of what is nearest to each; those without vectors stay."""
    dims = len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = _matrix(centroids)
        total = np.zeros((len(matrix), dims + 1), object)  # the last column counts
        for batch in batches:
            _, vectors = _read(batch, dims, scale)
            if len(vectors):
                cluster, _ = nearest(vectors, matrix)
                for c in np.unique(cluster):
                    here = cluster == c
                    total[c, :dims] += vectors[here].sum(axis=0)
                    total[c, dims] += int(here.sum())
        out = [(c, d, place, digit) for c in range(len(matrix)) for d in range(dims + 1) for place, digit in _digits(int(total[c, d]))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "dim", "place", "digit"])

    parts = rows.mapInArrow(sums, "cluster int, dim int, place int, digit long")
    total = np.zeros((len(centroids), dims + 1), object)
    # One row for each cluster, component and place of a digit: some thousands at most.
    for r in parts.groupBy("cluster", "dim", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit")).collect():
        total[r.cluster, r.dim] += int(r.digit) << (DIGIT * r.place)
    return [[int(x) // int(row[dims]) for x in row[:dims]] if row[dims] else old for row, old in zip(total, centroids)]


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, key: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that is kept.

    Kept are vectors of exactly `dims` components (a power of two), none null or not finite; their components become floor(scale * x). Rows of one
    id are vectors of their own; a null id is hashed as an empty one and stays null. Fewer vectors than `clusters`: as many centroids; none: an empty result.
    Sizes beyond 2^24 are computed with Python's integers; a distance or a sum that no long can hold is null.
    """
    if dims < LADDER[0] or dims & (dims - 1):
        raise ValueError("dims must be a power of two, 8 at least")
    send_code(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    centroids = first_centroids(rows, clusters, dims, scale)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids, scale)
    found = staged(assigned(rows, centroids, scale))
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = found.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), total).alias("sum"))
    own = {r.cluster: r["sum"] for r in sums.collect()}  # one row a cluster
    everything = None if None in own.values() else sum(own.values())
    fits = lambda x: None if x is None or x >= 2**63 else int(x)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    listed = [(i, fits(own.get(i)), fits(everything), digests[i]) for i in range(len(centroids))]
    facts = vectors.sparkSession.createDataFrame(listed, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> str:
    """The same for DuckDB, distances summed plainly; one vector an id."""
    parts = [
        f"""kept AS (
  SELECT vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dims}),
parts AS (SELECT vec_id, unnest(v) AS x, unnest(range({dims})) AS d FROM kept),
firsts AS (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM kept QUALIFY cluster < {clusters}),
c0 AS (SELECT cluster, unnest(v) AS x, unnest(range({dims})) AS d FROM firsts)"""
    ]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (
  SELECT vec_id, cluster, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS distance FROM parts p JOIN c{i} c USING (d) GROUP BY vec_id, cluster),
a{i} AS (SELECT vec_id, cluster, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            parts.append(f"""m{i} AS (
  SELECT cluster, d, CAST(sum(x) AS HUGEINT) AS total, count(*) AS n FROM a{i} JOIN parts USING (vec_id) GROUP BY cluster, d),
c{i + 1} AS (
  SELECT c.cluster, c.d, CASE WHEN n IS NULL THEN c.x ELSE CAST((total - ((total % n) + n) % n) // n AS BIGINT) END AS x FROM c{i} c LEFT JOIN m{i} m USING (cluster, d))""")
    return "WITH " + ",\n".join(parts) + f""",
digests AS (SELECT cluster, sha256(string_agg(x, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN digests USING (cluster)"""


SQL = _sql()
