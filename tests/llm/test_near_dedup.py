import random

import numpy as np
import pyarrow as pa
import pytest
from llm.helpers import awkward, empty, groups
from marketloom.llm import near_dedup
from marketloom.llm.components import components


def family(rng, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        yield " ".join(w)


def corpus(seed=3):
    rng, texts = random.Random(seed), []
    for _ in range(12):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice((8, 40, 120)))]
        texts += family(rng, base, rng.choice((1, 2, 6)), 3)
    hot = [f"v{rng.randrange(3000)}" for _ in range(150)]
    texts += family(rng, hot, 90, 12)  # more distinct members than a cold band may have
    texts += ["", None, "Tiny", "tiny", "two words", "  two\tWORDS ", texts[0], texts[0]]
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_equals_all_pairs(spark, k, percent):
    rows = corpus()
    found = near_dedup.find_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == groups(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


@pytest.mark.parametrize("share", [0.8, 0.9, 0.97])
def test_prefix_pairs_miss_none_at_the_threshold(spark, share):
    rng = random.Random(int(share * 100))
    base = [f"v{rng.randrange(3000)}" for _ in range(120)]
    rows = [(i, " ".join(w if rng.random() < share else f"f{i}x{rng.randrange(4)}" for w in base[rng.randrange(3):])) for i in range(150)]
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j:j + 3]) for j in range(len(w) - 2)}
    alike = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    members = spark.createDataFrame([(i, len(s), i, i % 2 == 0) for i, s in sets.items()], "cid long, n long, component long, outer boolean")
    texts = spark.createDataFrame(rows, "cid long, text string")
    found = {tuple(r) for r in near_dedup._prefix_pairs(members, texts, 3, 85).collect()}
    assert {p for p in alike if p[0] % 2 == 0 or p[1] % 2 == 0} <= found
    assert share > 0.9 or len(found) < 100  # a family below the threshold: 11,175 pairs in all


def test_prefix_pairs_of_a_family_below_the_threshold_are_few(spark):
    # every edit occurs in many texts, so no set is told apart by sequences of its own
    rng = random.Random(5)
    base = [f"v{i}" for i in range(110)]
    rows = [(i, " ".join(w if rng.random() < 0.97 else w + "x" for w in base)) for i in range(200)]
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j:j + 3]) for j in range(len(w) - 2)}
    alike = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    members = spark.createDataFrame([(i, len(s), i, True) for i, s in sets.items()], "cid long, n long, component long, outer boolean")
    found = {tuple(r) for r in near_dedup._prefix_pairs(members, spark.createDataFrame(rows, "cid long, text string"), 3, 85).collect()}
    assert alike <= found and len(found) < 2 * len(alike)


def test_clashing_columns_pass_through(spark):
    docs = spark.createDataFrame(corpus()[:40], "doc_id long, text string").selectExpr("*", "'k' AS kept_id", "'g' AS gone", "1 AS row", "2 AS n", "'u' AS uid", "'m' AS may")
    kept = near_dedup.drop_copies(docs, 3, 85)
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} == {("k", "g", 1, 2, "u", "m")}
    assert {r.doc_id for r in kept.collect()} == {r for _, r in groups(corpus()[:40], 3, 85).values()}


def test_awkward_rows(spark):
    docs = awkward(spark)
    found = near_dedup.find_groups(docs, 3, 85)
    assert found.count() == docs.count() and found.filter("n_shingles = 0 AND NOT kept").count() == 0
    kept = near_dedup.drop_copies(docs, 3, 85)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.select("doc_id").collect()) == [0, 1, 2, 3, 4, 7, 9, 10]
    assert near_dedup.find_groups(empty(spark)).count() == 0 and near_dedup.drop_copies(empty(spark)).count() == 0


def test_estimates_are_near(spark):
    rng = np.random.default_rng(5)
    for share in (0.5, 0.8, 0.95):
        common, n = rng.integers(0, 1 << 63, int(3000 * share)).astype(np.uint64) * np.uint64(2), 3000
        a, b = (np.unique(np.r_[common, rng.integers(0, 1 << 63, n - len(common)).astype(np.uint64) * np.uint64(2)]) for _ in "ab")
        regs = [near_dedup.registers(np.zeros(len(x), np.int64), x, 1) for x in (a, b)]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(near_dedup.estimate(*regs)[0] - true) < 0.16


def test_short_texts_are_one_sequence():
    text, value = near_dedup.shingle_sets(pa.array(["a b", "A  b", "b a", None, "a b c", "a b c d"]), 3)
    assert np.bincount(text, minlength=6).tolist() == [1, 1, 1, 0, 1, 2]
    assert value[0] == value[1] != value[2]


def test_components_of_a_star_a_path_and_loops(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(10_000 + i, 10_001 + i) for i in range(200)] + [(7, 7), (20_000, 20_001), (None, 3)]
    label = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(label) == 3000 + 201 + 2 and all(label[i] == 0 for i in range(3000)) and all(label[10_000 + i] == 10_000 for i in range(201)) and label[20_001] == 20_000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
