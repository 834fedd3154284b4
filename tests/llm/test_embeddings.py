"""Clustering with bounds and whitening against plain numpy and Python whole numbers."""
import hashlib
import math
import random

import numpy as np

from marketloom.llm import centroids, whitening

VECTORS = "vec_id long, embedding array<float>, cluster string, index string, x string, whitened string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "c", "i", "x", "w") for i, v in rows], VECTORS).repartition(parts)


def kept(rows, dim):
    return [(i, [math.floor(1024 * e) for e in v]) for i, v in rows if v is not None and len(v) == dim and all(e is not None and math.isfinite(e) for e in v)]


def plain_clusters(rows, k, rounds, seed, dim):
    points = kept(rows, dim)
    order = sorted(points, key=lambda p: (hashlib.sha256(f"{seed}:{'' if p[0] is None else p[0]}".encode()).hexdigest(), p[1]))
    centre = [list(p[1]) for p in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centre))

    for _ in range(rounds):
        members = [[] for _ in centre]
        for _, x in points:
            members[nearest(x)[1]].append(x)
        centre = [[sum(col) // len(m) for col in zip(*m)] if m else c for m, c in zip(members, centre)]
    found = [(i, *nearest(x)) for i, x in points]
    inertia = [sum(d for _, d, j in found if j == c) for c in range(len(centre))]
    mark = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted(((i, j, d, inertia[j], sum(inertia), mark[j]) for i, d, j in found), key=str)


def vectors(n, dim, seed, groups=5):
    rng = random.Random(seed)
    centre = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(groups)]
    f = np.float32
    return [(i, [float(f(rng.gauss(c, 0.2))) for c in centre[i % groups]]) for i in range(n)]


def odd(rows, dim):
    extra = [(9001, None), (9002, []), (9003, [1.0] * (dim - 1)), (9004, [None] + [1.0] * (dim - 1)), (9005, [float("nan")] * dim), (9006, [float("inf")] * dim), (None, [0.5] * dim)]
    return rows + extra + rows[:7]  # repeated rows


def test_clusters_equal_plain_version(spark):
    for n, k in ((400, 8), (5, 8), (1, 3)):
        rows = odd(vectors(n, 6, n), 6)
        got = centroids.cluster(frame(spark, rows), k, 10, 3, 6)
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_clusters(rows, k, 10, 3, 6)


def test_ties_and_equal_vectors(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(60)] + [(100 + i, [0.5, 0.0]) for i in range(20)]
    got = centroids.cluster(frame(spark, rows), 4, 10, 3, 2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_clusters(rows, 4, 10, 3, 2)


def test_bounds_spare_distances_and_stay_exact(spark):
    rows = vectors(3000, 8, 11, groups=12)
    _, history, evaluated = centroids.fit(centroids.whole_vectors(frame(spark, rows), 8), 8, 10, 3)
    assert len(history) == 11 and evaluated[0] == 3000 * 8
    assert sum(evaluated[3:]) < 0.5 * 3000 * 8 * len(evaluated[3:])


def test_total_displacement_is_tighter_than_summed_drifts():
    there_and_back = np.array([[[0, 0]], [[10, 0]], [[1, 0]]])
    assert centroids.displacements(there_and_back)[:, 0].tolist() == [1.0, 9.0, 0.0]


def test_empty_embeddings(spark):
    assert centroids.cluster(frame(spark, []), 8).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance


def test_whitening_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    dim = 10
    rows = odd([(i, [float(np.float32(e * (j + 1))) for j, e in enumerate(v)]) for i, v in vectors(900, dim, 5)], dim)
    points = [(i, [e + 100_000 for e in x]) for i, x in kept(rows, dim)]
    x = np.array([p[1] for p in points], dtype=np.float64)
    n, sums = len(points), [sum(col) for col in zip(*[p[1] for p in points])]
    centred = x - x.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    assert sorted({(r.vec_id, int(r.deviation)) for r in got}, key=str) == sorted({(i, sum((n * e - s) ** 2 for e, s in zip(p, sums))) for i, p in points}, key=str)
    for k in range(8):
        mine = {r.vec_id: r.whitened for r in got if r.component == k + 1}
        want = dict(zip([p[0] for p in points], centred @ axes[:, k] / np.sqrt(values[k])))
        sign = np.sign(mine[0] * want[0])
        assert all(abs(mine[i] - sign * want[i]) < 1e-6 for i in want)
        assert np.allclose([r.explained for r in got if r.component == k + 1], values[k] / values.sum(), rtol=1e-9)


def test_flat_components_are_not_given(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random(), 3.0, 3.0]) for i in range(50)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1} and len(got) == 50
