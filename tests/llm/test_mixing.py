from collections import defaultdict

import pytest
from llm.helpers import awkward, empty, words
from marketloom.llm import mixing
from pyspark.sql import functions as F


def shared_out(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by sharing the excess again until none is above its ceiling."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, full, out = share * sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        now = {s: (left - sum(most * sizes[f] for f in full)) * weight[s] / total for s in open_} if total else {}
        above = [s for s in open_ if now[s] > most * sizes[s]]
        if not above:
            return now | {s: most * sizes[s] for s in full}
        full |= set(above)


@pytest.fixture(scope="module")
def planned(spark):
    docs = awkward(spark, [(100 + i, "w " * (i % 40), "en", "hot" if i % 3 else "b") for i in range(400)])
    return docs, mixing.plan(mixing.sizes(docs)).collect()


def test_targets_and_budgets(planned):
    docs, rows = planned
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.epochs * r["size"] + r.part
    want = shared_out(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)
    assert len(rows) == docs.count()


def test_sizes_count_words(spark):
    docs = awkward(spark)
    got = sorted((r.doc_id or 0, r["size"]) for r in mixing.sizes(docs).collect())
    assert got == sorted((r.doc_id or 0, len(words(r.text))) for r in docs.collect())


def test_reruns_agree(spark, planned):
    docs, rows = planned
    again = mixing.plan(mixing.sizes(docs.repartition(7))).collect()
    key = lambda r: (r.doc_id or -1, r.source or "", r["size"], r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mixture_has_the_planned_words(spark, planned):
    docs, rows = planned
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    total = out.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert total == sum(r.taken for r in rows)
    original = {r.doc_id: r.text for r in docs.collect()}
    assert all(original[r.doc_id].startswith(r.text) for r in out.select("doc_id", "text").collect())


def test_empty(spark):
    assert mixing.plan(mixing.sizes(empty(spark))).count() == 0 and mixing.mix(empty(spark)).count() == 0
