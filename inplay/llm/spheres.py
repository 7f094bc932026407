"""Exact integer k-means whose bounds are loosened by the geometry of cluster spheres instead of by full drift."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inplay.llm.storage import discard, keep

#: Components are held to this size, so that every squared distance fits a long.
LARGEST = 1 << 26
#: Whole numbers below it are exact as doubles.
EXACT = 1 << 53
#: Bounds are doubles; a vector counts as decided only when they differ by more than this share.
SLACK = 1e-9

STATE = "vector binary, cluster int, upper double, lower double, scanned boolean"


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (points x centroids) of whole-number vectors, as longs."""
    if not len(points) or not len(centroids):
        return np.zeros((len(points), len(centroids)), np.int64)
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * points.shape[1] * most * most < EXACT:  # then every partial sum below is a whole number that a double holds
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)


def scan(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, ties to the smaller number; distance to it; distance to the next nearest) of each point."""
    far = squared(points, centroids)
    nearest = far.argmin(1)
    rows = np.arange(len(points))
    upper = np.sqrt(far[rows, nearest].astype(np.float64))
    if far.shape[1] == 1:
        return nearest, upper, np.full(len(points), np.inf)
    rest = far.astype(np.float64)
    rest[rows, nearest] = np.inf
    return nearest, upper, np.sqrt(rest.min(1))


def tightened_drift(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Entry [i][j]: by how much at most the distance to centroid j shrinks, for any point of cluster i, when j moves
    from old[j] to new[j]; all points of cluster i lie within radius[i] of old[i].

    With m the middle of j's move and v the move, |x - old| - |x - new| = 2 v.(x - m) / (|x - old| + |x - new|), and the
    two distances add up to 2 |x - m| at least. So the loss is at most |v| cos(angle at m between v and x - m). Over a
    sphere that angle is least in the plane of v and the sphere's centre: the centre's angle less that of the tangent
    from m. A sphere wholly behind m loses nothing, one that holds m may lose the full drift."""
    k = len(old)
    out = np.zeros((k, k))
    move = (new - old).astype(np.float64)
    drift = np.sqrt((move * move).sum(1))
    for j in range(k):
        if not drift[j]:
            continue
        to = old.astype(np.float64) - (old[j] + new[j]) / 2.0  # from the middle of the move to each sphere's centre
        length = np.sqrt((to * to).sum(1))
        outside = length > radius
        safe = np.where(outside, length, 1.0)
        centre = np.arccos(np.clip(to @ move[j] / (safe * drift[j]), -1, 1))
        tangent = np.arcsin(np.clip(np.where(outside, radius, 0.0) / safe, 0, 1))
        angle = np.where(outside, np.maximum(centre - tangent, 0), 0.0)
        out[:, j] = drift[j] * np.maximum(np.cos(angle), 0) * (1 + SLACK)
    np.fill_diagonal(out, 0)
    return out


def reassign(points: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray,
             drift: np.ndarray, loss: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Clusters and bounds after the centroids moved, and which points were scanned. A point stays unseen while its
    loosened bounds keep apart; then its own distance is computed, and only if that does not decide all of them."""
    cluster, upper, lower = cluster.copy(), upper + drift[cluster], lower - loss[cluster]
    apart = lambda: upper * (1 + SLACK) + SLACK < lower
    doubtful = np.flatnonzero(~apart())
    own = points[doubtful] - centroids[cluster[doubtful]]
    upper[doubtful] = np.sqrt((own * own).sum(1).astype(np.float64))
    scanned = ~apart()
    at = np.flatnonzero(scanned)
    if len(at):
        cluster[at], upper[at], lower[at] = scan(points[at], centroids)
    return cluster, upper, lower, scanned


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), width).astype(np.int64)


def _packed(column: pa.Array, width: int, scale: int) -> pa.Array:
    values = np.asarray(column.flatten(), np.float64).reshape(len(column), width) * scale
    whole = np.clip(np.floor(values), -LARGEST, LARGEST).astype("<i4")
    return pa.array([row.tobytes() for row in whole], pa.binary())


def valid(df: DataFrame, vector: str, width: int) -> DataFrame:
    """Rows whose vector has exactly `width` components, none null, infinite or not a number."""
    doubles = F.col(f"`{vector}`").cast("array<double>")
    whole = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter((F.size(doubles) == width) & whole)


def seeds(df: DataFrame, id_column: str, k: int, seed: str, width: int) -> np.ndarray:
    """The vectors of the k rows with the least sha256 of '<seed>:<id>' (equal ones: the least vector), in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))), 256)
    return _vectors(pa.array([r["vector"] for r in df.orderBy(key, "vector").limit(k).select("vector").collect()], pa.binary()), width)


def _totals(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
    """Count, componentwise sums and radius (largest upper bound) per cluster. Each task adds up its own vectors; what
    meets in the group-by is k rows a batch, and what comes to the driver k * (width + 2) numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, cluster = _vectors(batch.column(0), width), np.asarray(batch.column(1))
            upper = np.asarray(batch.column(2))
            some = np.unique(cluster)
            member = [cluster == c for c in some]
            yield pa.RecordBatch.from_arrays([
                pa.array(some, pa.int32()), pa.array([int(m.sum()) for m in member], pa.int64()), pa.array([upper[m].max() for m in member], pa.float64()),
                pa.array([vectors[m].sum(0).tolist() for m in member], pa.list_(pa.int64()))], names=["cluster", "n", "radius", "sums"])

    parts = state.select("vector", "cluster", "upper").mapInArrow(add, "cluster int, n long, radius double, sums array<long>")
    sums = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    count, radius, total = np.zeros(k, np.int64), np.zeros(k), [[0] * width for _ in range(k)]
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), *sums).collect():
        count[r["cluster"]], radius[r["cluster"]] = r["n"], r["radius"]
        total[r["cluster"]] = [int(r[f"s{i}"]) for i in range(width)]
    return count, total, radius


def centroid_clusters(df: DataFrame, k: int = 16, rounds: int = 3, id_column: str = "vec_id", vector: str = "embedding", width: int = 64,
                      scale: int = 64, seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """Cluster the vectors of `df` about k centroids in exact whole numbers: (rows, centroids).

    Rows: `id_column`, cluster int, distance long (squared, to the cluster's centroid), scanned boolean (whether the last
    round compared the vector with every centroid). A component x becomes floor(scale * x), held to plus or minus 2^26.
    Each round every non-empty centroid becomes the componentwise floor of its vectors' mean; empty ones stay where they
    are. After the last round vectors are assigned once more.

    The first assignment scans all; it leaves each vector an upper bound on the distance to its own centroid and a
    lower one on the distance to any other. When centroids have moved, the lower bound falls by the most that
    `tightened_drift` allows for the sphere about its cluster, and only vectors whose bounds meet are looked at again.
    Bounds travel with the vectors in a table in the shared folder, one per round, the one before is deleted; vectors are
    never shuffled, and the driver holds centroids and sums alone (k * width numbers).

    Rows whose vector is null, of another width or holds a null or non-finite component are left out. Repeated rows and
    ids are rows of their own; a null id counts as empty text where seeds are drawn and comes out null. Ties go to the
    smaller centroid. Fewer rows than k make fewer centroids; an empty table gives an empty result. Columns other than
    the two named ones are not read, so their names may be anything."""
    ids = F.col(f"`{id_column}`")
    id_type = df.select(ids.alias("id")).schema["id"].dataType
    packed = lambda batches: (pa.RecordBatch.from_arrays([b.column(0), _packed(b.column(1), width, scale)], names=["id", "vector"]) for b in batches)
    rows = valid(df, vector, width).select(ids.alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    rows = rows.mapInArrow(packed, T.StructType([T.StructField("id", id_type), T.StructField("vector", T.BinaryType())]))
    centroids = seeds(rows, "id", k, seed, width)
    schema = f"id {id_type.simpleString()}, {STATE}"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, upper, lower = scan(_vectors(batch.column(1), width), centroids)
            yield _state(batch, cluster, upper, lower, np.ones(len(cluster), bool))

    def again(now: np.ndarray, drift: np.ndarray, loss: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _state(batch, *reassign(_vectors(batch.column(1), width), *[np.asarray(batch.column(i)) for i in (2, 3, 4)], now, drift, loss))
        return run

    state = keep(rows.mapInArrow(first, schema), "spheres")
    for _ in range(rounds):
        count, total, radius = _totals(state, len(centroids), width)
        moved = np.array([[s // int(n) for s in line] if n else at.tolist() for n, line, at in zip(count, total, centroids)], np.int64).reshape(-1, width)
        drift = np.sqrt(((moved - centroids) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        shrunk = tightened_drift(centroids, moved, radius * (1 + SLACK))
        loss = shrunk.max(1, initial=0.0)
        before, state = state, keep(state.mapInArrow(again(moved, drift, loss), schema), "spheres")
        discard(before)
        centroids = moved

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = np.asarray(batch.column(2))
            apart = _vectors(batch.column(1), width) - centroids[cluster]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array((apart * apart).sum(1), pa.int64()), batch.column(5)],
                                             names=["id", "cluster", "distance", "scanned"])

    out = state.mapInArrow(finish, f"id {id_type.simpleString()}, cluster int, distance long, scanned boolean")
    return out.withColumnRenamed("id", id_column), centroids


def _state(batch: pa.RecordBatch, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scanned: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(upper, pa.float64()),
                                       pa.array(lower, pa.float64()), pa.array(scanned, pa.bool_())], names=["id", "vector", "cluster", "upper", "lower", "scanned"])


def with_inertia(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds `cluster_inertia` and `inertia` long (distances summed over the row's cluster and over all) and
    `centroid_sha256` (of the centroid's components as decimals joined by commas). The sums come to the driver: one
    number a centroid."""
    if not len(centroids):
        return clustered.select("*", F.lit(None).cast("long").alias("cluster_inertia"), F.lit(None).cast("long").alias("inertia"), F.lit(None).cast("string").alias("centroid_sha256"))
    sums = {r["cluster"]: int(r["s"]) for r in clustered.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    of = F.array(*[F.struct(F.lit(sums.get(i, 0)).cast("long").alias("s"), F.lit(hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()).alias("h")) for i, c in enumerate(centroids)])
    mine = F.get(of, F.col("cluster"))
    return clustered.select("*", mine["s"].alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), mine["h"].alias("centroid_sha256"))
