"""Centroid clustering in whole numbers, with lower bounds that loosen by geometry instead of by the full drift.

Every vector keeps a lower bound on its distance to all centroids but its own.  When centroids move, a bound is
not loosened by how far a centroid went, but by how much nearer it can have come to any point of the vector's
cluster: the cluster lies in a sphere, and in the plane through the sphere's middle and the centroid's way the
sphere fills an angle.  Whoever stays under the bound keeps its cluster unseen; all others are compared exactly.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campusflow.llm.stored import shared_folder

# A component's largest size; it keeps every distance inside a long, for up to 2^8 components.
LARGEST = 1 << 27
# Vectors compared at a time, which bounds a worker's memory.
CHUNK = 4096
# Rounding of square roots and cosines must never decide that a vector need not be compared.
SAFE = 1e-9


def whole_vectors(vectors: DataFrame, dims: int = 64, scale: int = 64, vector: str = "embedding") -> DataFrame:
    """``row`` and ``x``: ``floor(scale * component)`` of the vectors with ``dims`` components, all finite."""
    row = F.struct(*[vectors[f"`{c}`"] for c in vectors.columns]).alias("row")
    doubles = vectors[f"`{vector}`"].cast("array<double>")

    def sound(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    def whole(x: Column) -> Column:
        bounded = F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(scale * x).cast("double")))
        return bounded.cast("int")

    kept = vectors.filter((F.size(doubles) == dims) & F.forall(doubles, sound))
    return kept.select(row, F.transform(doubles, whole).alias("x"))


@dataclass(frozen=True)
class Move:
    """The centroids, and for each cluster how far a lower bound has to be loosened since the round before."""

    centroids: np.ndarray
    loosened: np.ndarray | None = None


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster: the most that any other centroid's way brings it nearer to a point of the cluster's sphere.

    Seen from the old place of a centroid, a point that lies at the angle t to its way comes nearer by at most
    cos(t) times the way.  The points of a sphere with radius r, whose middle lies at distance D and angle p, are
    at angles of at least p - asin(r / D), measured in the plane through the way and the middle.  Beyond a right
    angle the cosine is negative: the centroid goes away from all of them and the bound may even grow.
    """
    k = len(old)
    ways = (new - old).astype(np.float64)
    drift = np.sqrt((ways**2).sum(1))
    result = np.full(k, -np.inf)
    for i in range(k):
        to_middle = (old[i] - old).astype(np.float64)
        far = np.sqrt((to_middle**2).sum(1))
        for j in range(k):
            if j == i:
                continue
            if not drift[j]:
                nearer = 0.0
            elif far[j] <= radius[i] * (1 + SAFE):
                nearer = drift[j]  # the sphere surrounds the centroid
            else:
                angle = np.arccos(np.clip(to_middle[j] @ ways[j] / (far[j] * drift[j]), -1, 1))
                nearer = drift[j] * np.cos(max(0.0, angle - np.arcsin(radius[i] / far[j])))
            result[i] = max(result[i], nearer + SAFE * (drift[j] + far[j] + radius[i]))
    return result if k > 1 else np.zeros(k)


def _exact(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector its nearest centroid (ties: the first), the squared distance, and a bound under the second."""
    squared = np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)
    cluster = squared.argmin(1)
    at = np.arange(len(x))
    nearest = squared[at, cluster]
    if len(centroids) == 1:
        return cluster, nearest, np.full(len(x), np.inf)
    squared[at, cluster] = np.iinfo(np.int64).max
    return cluster, nearest, np.sqrt(squared.min(1).astype(np.float64)) * (1 - SAFE)


def _assigner(move: Move):
    """Batches of vectors with cluster, squared distance, lower bound, and whether they were compared exactly."""
    centroids, loosened = move.centroids, move.loosened

    def chunk(part: pa.RecordBatch) -> pa.RecordBatch:
        column = part.column("x")
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.int64)
        if loosened is None:
            cluster, distance, bound = _exact(x, centroids)
            scanned = np.ones(len(x), bool)
        else:
            cluster = part.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            bound = part.column("bound").to_numpy(zero_copy_only=False) - loosened[cluster]
            distance = ((x - centroids[cluster]) ** 2).sum(1)
            scanned = np.sqrt(distance.astype(np.float64)) * (1 + SAFE) >= bound
            if scanned.any():
                cluster, bound = cluster.copy(), bound.copy()
                cluster[scanned], distance[scanned], bound[scanned] = _exact(x[scanned], centroids)
        values = [part.column("row"), column, pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(bound), pa.array(scanned)]
        return pa.RecordBatch.from_arrays(values, ["row", "x", "cluster", "distance", "bound", "scanned"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                yield chunk(batch.slice(start, CHUNK))

    return assign


def first_centroids(points: DataFrame, k: int, vec_id: str) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``1:<id>``, in that order; equal hashes go by their components."""
    named = F.concat(F.lit("1:"), F.coalesce(F.col("row").getField(vec_id).cast("string"), F.lit("")))
    rows = points.select(F.sha2(named, 256).alias("hash"), "x").orderBy("hash", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def _means(assigned: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The floored mean of every cluster (an empty one stays) and the radius of its sphere; one row a cluster comes back."""
    dims = centroids.shape[1]
    sums = [F.sum(F.get("x", F.lit(d)).cast("long")).alias(f"s{d}") for d in range(dims)]
    rows = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), *sums).collect()
    new, radius = centroids.copy(), np.zeros(len(centroids))
    for r in rows:
        new[r.cluster] = [r[f"s{d}"] // r.n for d in range(dims)]
        radius[r.cluster] = np.sqrt(float(r.far)) * (1 + SAFE)
    return new, radius


def _delete(frame: DataFrame, folder: str) -> None:
    jvm = frame.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The vectors with ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256``, ``scanned``.

    Vectors of another number of components, or with a NULL, NaN or infinite one, are left out; the others are taken
    as whole numbers ``floor(scale * component)``, at most 2^27 in size.  Each round assigns every vector to the
    nearest centroid (ties: the smaller number) and moves every centroid that has vectors to their floored mean; a
    last assignment follows.  ``scanned`` says whether the last one had to compare the vector with every centroid.

    Repeated ids and rows are vectors each.  A NULL id counts as an empty one for the choice of the first centroids;
    with fewer than ``k`` vectors there are as many centroids as vectors; an empty table gives an empty result.  An
    inertia that does not fit into a long is NULL.  A caller's column with the name of an added one is replaced.

    Each round writes the vectors with cluster and bound as Parquet to the shared folder and deletes the round
    before, so a lost executor repeats one round at most.  To the driver come ``k`` rows a round.
    """
    spark = vectors.sparkSession
    points = whole_vectors(vectors, dims, scale, vector)
    folder = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"
    centroids = first_centroids(points, k, vec_id)
    kinds = {"cluster": "int", "distance": "long", "bound": "double", "scanned": "boolean"}
    schema = points.withColumns({n: F.lit(None).cast(t) for n, t in kinds.items()}).schema
    now, move = points, Move(centroids)
    if not len(centroids):
        now = points.limit(0).withColumns({n: F.lit(None).cast(t) for n, t in kinds.items()})
    else:
        for step in range(rounds + 1):
            now.mapInArrow(_assigner(move), schema).write.parquet(f"{folder}/{step}")
            now = spark.read.schema(schema).parquet(f"{folder}/{step}")
            if step:
                _delete(now, f"{folder}/{step - 1}")
            if step < rounds:
                moved, radius = _means(now, move.centroids)
                move = Move(moved, loosening(move.centroids, moved, radius))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in move.centroids.tolist()]
    inertia = now.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    sums = {r.cluster: r.cluster_inertia for r in inertia.collect()}
    total = None if None in sums.values() or sum(sums.values()) >= 1 << 63 else sum(sums.values())
    # One row a cluster, so it is safe to broadcast.
    facts = [(i, sums.get(i), total, d) for i, d in enumerate(digests)]
    of_cluster = spark.createDataFrame(facts, "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = now.join(F.broadcast(of_cluster), now["cluster"] == of_cluster["number"])
    added = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")
    taken = set(added)
    kept = [F.col("row").getField(c).alias(c) for c in vectors.columns if c.lower() not in taken]
    return joined.select(*kept, *added)


def cluster_vectors_sql(table: str = "embeddings", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """DuckDB: the same clusters, every vector compared with every centroid in every round."""
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id,
                [least({LARGEST}, greatest({-LARGEST}, floor({scale} * c::DOUBLE)))::BIGINT FOR c IN embedding] AS x
            FROM {table} WHERE len(embedding) = {dims} AND len([c FOR c IN embedding IF c IS NOT NULL AND isfinite(c)]) = {dims})""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x AS c
            FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM kept ORDER BY h, x LIMIT {k}))""",
    ]
    for step in range(rounds + 1):
        steps.append(
            f"""a{step} AS MATERIALIZED (
            SELECT r, min((d, cluster)) AS best FROM (
                SELECT r, cluster, list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, {dims} + 1)])::BIGINT AS d
                FROM kept CROSS JOIN c{step}) GROUP BY r)"""
        )
        if step < rounds:
            steps.append(
                f"""m{step} AS (
            SELECT cluster, list(m ORDER BY i) AS c FROM (
                SELECT cluster, i, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS m
                FROM (SELECT best[2] AS cluster, unnest(x) AS v, unnest(range({dims})) AS i
                    FROM a{step} JOIN kept USING (r)) GROUP BY cluster, i) GROUP BY cluster),
        c{step + 1} AS MATERIALIZED (
            SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{step} AS o LEFT JOIN m{step} AS m USING (cluster))"""
            )
    return f"""
        WITH {", ".join(steps)}
        SELECT vec_id, best[2]::INT AS cluster, best[1]::BIGINT AS distance,
            (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} ON cluster = best[2]"""
