"""Centroid clustering in whole numbers with bounds that follow the norm of total displacement.

Every vector keeps one distance bound per centroid and the round in which it was evaluated: an upper
bound for its own centroid, lower bounds for the others. All centroids of all rounds are kept (a few
kilobytes). In a later round a bound is loosened by the distance between the centroid's place now and
its place in the round of the evaluation, which is never more than the sum of the drifts in between.
Where a lower bound does not exceed the upper one, the distance to the own centroid is evaluated first,
then those to the centroids whose bounds still fail, exactly in 64-bit whole numbers. A bound that
holds proves a strictly greater distance, so ties are always decided exactly (smaller number).

The vectors with their bounds are persisted in each round, in memory and on local disks; the lineage
of at most `rounds` narrow steps leads back to a written table, so a lost executor's part is computed
again from there. A round sends only the sums of each cluster to the driver.

Kept are vectors with exactly `dim` components that are neither null nor non-finite and whose
magnitude is below 2**17, as no 64-bit distance could hold more. Null ids and repeated rows are vectors
of their own; a null id hashes as the empty string, and equal hashes are ordered by their components.
With fewer vectors than centroids there are as many centroids as vectors; an empty table gives an empty
result. Only the two named columns are read; extra columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, LARGEST = 1024, 1 << 17
#: Relative room for rounding when bounds are compared.
ROOM = 1e-9
STATE = "vec_id long, x array<int>, cluster int, bounds array<double>, seen array<int>, evaluated int"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_vectors(vectors: DataFrame, dim: int = 64, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and floor(1024 * component) of the vectors that are kept."""
    v = F.col(vector)
    good = F.coalesce((F.size(v) == dim) & F.forall(v, lambda e: e.isNotNull() & (F.abs(e) < F.lit(float(LARGEST)))), F.lit(False))
    return vectors.filter(good).select(F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda e: F.floor(e.cast("double") * SCALE).cast("int")).alias("x"))


def first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of seed and identifier."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in points.select(mark.alias("mark"), "x").orderBy("mark", "x").limit(k).collect()], dtype=np.int64)


def displacements(history: np.ndarray) -> np.ndarray:
    """How far each centroid of the last round is from its place in every round: rounds by centroids."""
    return np.sqrt(((history - history[-1]) ** 2).sum(2, dtype=np.float64))


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return (d * d).sum(1)


def assign(x: np.ndarray, cluster: np.ndarray, bounds: np.ndarray, seen: np.ndarray, history: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Brings cluster, bounds and seen up to the last round of the history, in place; distances evaluated for each row."""
    now, rows = len(history) - 1, np.arange(len(x))
    away = moved[seen, np.arange(len(moved[0]))]
    low = bounds - away
    up = bounds[rows, cluster] + away[rows, cluster]
    low[rows, cluster] = np.inf
    count = np.zeros(len(x), np.int32)
    open_ = np.flatnonzero((low * (1 - ROOM) <= up[:, None] * (1 + ROOM)).any(1))
    best = np.empty(len(x), np.int64)
    for j in range(history.shape[1]):  # the own centroid first
        own = open_[cluster[open_] == j]
        best[own] = squared(x[own], history[now, j])
    bounds[open_, cluster[open_]] = up[open_] = np.sqrt(best[open_].astype(np.float64))
    seen[open_, cluster[open_]] = now
    count[open_] += 1
    failing = low[open_] * (1 - ROOM) <= up[open_, None] * (1 + ROOM)
    for j in range(history.shape[1]):
        at = open_[failing[:, j]]
        if not len(at):
            continue
        found = squared(x[at], history[now, j])
        bounds[at, j], seen[at, j] = np.sqrt(found.astype(np.float64)), now
        count[at] += 1
        closer = (found < best[at]) | ((found == best[at]) & (j < cluster[at]))
        best[at[closer]], cluster[at[closer]] = found[closer], j
    return count


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.flatten()).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    edges = np.arange(0, values.size + 1, max(1, values.shape[1]), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.ascontiguousarray(values).ravel(), type=kind))


def advance(state: DataFrame, history: np.ndarray) -> DataFrame:
    """Vectors assigned to the centroids of the last round of the history; a bare (vec_id, x) is evaluated in full."""
    moved, k, dim = displacements(history), history.shape[1], history.shape[2]
    fresh = "cluster" not in state.columns

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = _matrix(batch.column(1), dim).astype(np.int64)
            if fresh:
                cluster, bounds, seen = np.zeros(n, np.int32), np.zeros((n, k)), np.zeros((n, k), np.int32)
            else:
                cluster, bounds, seen = np.array(batch.column(2)), _matrix(batch.column(3), k), _matrix(batch.column(4), k)
            count = assign(x, cluster, bounds, seen, history, moved)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), _lists(bounds, pa.float64()), _lists(seen, pa.int32()), pa.array(count)],
                                             ["vec_id", "x", "cluster", "bounds", "seen", "evaluated"])

    return state.mapInArrow(run, STATE)


def cluster_sums(state: DataFrame, dim: int) -> DataFrame:
    """(cluster, n, array of exact component sums): added up in each batch, then by one small aggregate."""
    def run(batches):
        for batch in batches:
            x, cluster = _matrix(batch.column(1), dim).astype(np.int64), np.array(batch.column(0))
            order = np.argsort(cluster, kind="stable")
            ids, starts, n = np.unique(cluster[order], return_index=True, return_counts=True)
            sums = np.add.reduceat(x[order], starts) if len(ids) else np.empty((0, dim), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(n.astype(np.int64)), _lists(sums, pa.int64())], ["cluster", "n", "s"])

    part = state.select("cluster", "x").mapInArrow(run, "cluster int, n long, s array<long>")
    return part.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("s"))


def fit(points: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> tuple[DataFrame | None, np.ndarray, list[int]]:
    """Assigned vectors, the centroids of every round and the number of distances that each round evaluated."""
    start = first_centroids(points, k, seed)
    if not len(start):
        return None, start, []
    history, evaluated, state = start[None], [], points
    for turn in range(rounds + 1):
        before, state = state, advance(state, history).persist(StorageLevel.MEMORY_AND_DISK)
        evaluated.append(state.agg(F.sum("evaluated")).first()[0])
        if turn < rounds:
            centre = history[-1].copy()
            for r in cluster_sums(state, history.shape[2]).collect():
                centre[r.cluster] = [s // r.n for s in r.s]
            history = np.concatenate([history, centre[None]])
        if before is not points:
            before.unpersist()
    return state, history, evaluated


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per kept vector, as `RESULT` names them."""
    spark = vectors.sparkSession
    points = stored(whole_vectors(vectors, dim, vector, key), "points")
    state, history, _ = fit(points, k, rounds, seed)
    if state is None:
        return spark.createDataFrame([], RESULT)
    final = history[-1]
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]

    def run(batches):
        for batch in batches:
            x, own = _matrix(batch.column(1), dim).astype(np.int64), np.array(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(squared(x, final[own]))], ["vec_id", "cluster", "distance"])

    placed = stored(state.select("vec_id", "x", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long"), "placed")
    state.unpersist()
    inertia = {r.cluster: r.d for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    own = F.array(*[F.lit(inertia.get(j, 0)).cast("long") for j in range(len(final))])
    return placed.select("vec_id", "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"),
                         F.get(F.array(*map(F.lit, marks)), F.col("cluster")).alias("centroid_sha256"))
