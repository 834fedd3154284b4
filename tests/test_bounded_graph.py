"""Bounds of the block search and of readable connections."""
import numpy as np
from pyspark.sql import functions as F

from marketloom.operators import graph as G


def test_blocks_of_vectors_are_small_and_lose_nothing(spark):
    m = np.random.default_rng(3).normal(size=(17_000, 4))
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)], "vec_id long, embedding array<double>")
    d = G.vector_search(rows, rows.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding"), 5)
    assert G.VECTOR_BLOCK * 64 * 8 <= 8 << 20
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(q, int(v)) for q in range(3) for v in np.argsort(-(u @ u[q]))[:5]}
    assert {(r.query_id, r.vec_id) for r in d.collect()} == want


def graph(spark):
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "a", "c"), ("e3", "a", "gone"), ("e4", "b", "d"), ("e5", "gone", "f")], "id string, from_id string, to_id string")
    edges = edges.selectExpr("*", "'R' AS relation_type", "1.0D AS weight", "timestamp '2001-01-01' AS created_at", "1.0D AS confidence")
    nodes = spark.createDataFrame([(x, x.upper()) for x in "abcdf"], "id string, canonical_name string")
    return edges, nodes, nodes.where("id = 'a'").select("id")


def test_connections_rank_live_rows_before_names_are_joined(spark):
    edges, nodes, starts = graph(spark)
    now = F.lit("2001-01-01").cast("timestamp")
    d = G.connections(edges, nodes, starts, 2, now, 3)
    got = sorted((r.hop, r.src_name, r.tgt_name, r.relation_type) for r in d.collect())
    assert got == [(1, "A", "B", "R"), (1, "A", "C", "R"), (2, "B", "D", "R")]
    plan = d._jdf.queryExecution().optimizedPlan().toString().split("\n")
    ranked = next(i for i, line in enumerate(plan) if "row_number()" in line)
    assert any("Join Inner" in line for line in plan[:ranked])


def test_tree_rows_are_grouped_where_the_join_has_put_them(spark):
    from marketloom.operators import walks
    edges, _, starts = graph(spark)
    d = walks.tree(edges, starts, 2)
    assert "hashpartitioning(start" not in d._jdf.queryExecution().executedPlan().toString()
    assert {(r.start, r.hop, r.src, r.edge, r.tgt) for r in d.collect()} == {
        ("a", 1, "a", "e1", "b"), ("a", 1, "a", "e2", "c"), ("a", 1, "a", "e3", "gone"),
        ("a", 2, "b", "e4", "d"), ("a", 2, "gone", "e5", "f")}
