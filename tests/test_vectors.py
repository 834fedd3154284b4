"""The cell index against brute force: clustered, repeated, zero, unusable and unbalanced vectors."""
import math

import numpy as np
import pytest

from marketloom.operators import vectors as V

SCHEMA = "vec_id long, embedding array<double>, score string, cell string"


def clustered(n, dim, groups, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    return [(k, [float(x) for x in centre[k % groups] + rng.normal(size=dim) * spread]) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(k, e, "s", "c") for k, e in rows], SCHEMA)


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, embedding array<double>")


def brute(rows, questions, k, threshold=-math.inf):
    def unit(e):
        n = math.sqrt(sum(x * x for x in e))
        return [x / n for x in e] if n else e

    held, out = [(i, unit(e)) for i, e in rows], {}
    for q, e in questions:
        u = unit(e)
        scores = sorted((-round(sum(a * b for a, b in zip(u, v)), 9), i) for i, v in held)
        out[q] = [i for s, i in scores if -s >= threshold][:k]
    return {q: v for q, v in out.items() if v}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("threshold", [None, 0.35])
def test_equals_brute_force_and_skips(spark, monkeypatch, threshold):
    monkeypatch.setattr(V, "QUERY_BLOCK", 9)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 13)
    rows = clustered(600, 8, 12, 4)
    questions = [r for r in rows if r[0] % 20 == 0] + [(1001, [1.0] * 8)]
    index = V.build(frame(spark, rows).repartition(5), 8)
    got = found(V.search(index, asked(spark, questions), 7, threshold))
    assert got == brute(rows, questions, 7, -math.inf if threshold is None else threshold)
    seen = V.opened(index, asked(spark, questions[:-1]), 7, threshold).collect()
    assert len(seen) == 30 and sum(r.opened for r in seen) < 0.4 * sum(r.cells for r in seen)


def test_isotropic_vectors_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=16)]) for k in range(300)]
    index = V.build(frame(spark, rows), 16)
    assert found(V.search(index, asked(spark, rows[:25]), 5)) == brute(rows, rows[:25], 5)


def test_ties_copies_zeros_and_unusable_vectors(spark):
    rows = clustered(60, 4, 3, 9)
    rows += [(100 + k, rows[0][1]) for k in range(80)] + [(300, [0.0] * 4), (301, [0.0] * 4), (302, [1e-200, 0.0, 0.0, 0.0])]
    odd = [(400, None), (401, [1.0]), (402, [1.0, None, 0.0, 0.0]), (403, [float("nan"), 0.0, 0.0, 0.0]), (404, [float("inf"), 0.0, 0.0, 0.0]), (405, [])]
    questions = [rows[0], rows[1], (300, [0.0] * 4), (999, [-x for x in rows[0][1]])]
    index = V.build(frame(spark, rows + odd), 4, cells=6)
    assert index.rows.count() == len(rows)
    want = brute([(i, [x * 1e200 for x in e] if i == 302 else e) for i, e in rows], questions, 12)
    assert found(V.search(index, asked(spark, questions + odd), 12)) == want
    assert want[0][0] == 0 and want[0][1:] == list(range(100, 111))


def test_fewer_rows_than_k_and_empty_tables(spark):
    rows = clustered(5, 3, 2, 1)
    index = V.build(frame(spark, rows), 3)
    assert found(V.search(index, asked(spark, rows), 9)) == brute(rows, rows, 9)
    assert V.search(index, asked(spark, []), 9).count() == 0
    nothing = V.build(frame(spark, []), 3)
    assert V.search(nothing, asked(spark, rows), 9).collect() == [] and not len(nothing.cells)
