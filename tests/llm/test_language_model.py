"""The recurrent model: gradients, windows, proper probabilities, and whole scores against plain Python."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketloom.llm import gru, language_model as L, textscan

SCHEMA = "doc_id long, text string, n string, value long, rid string, outline int"


def held():
    return F.crc32(F.col("doc_id").cast("string")) % 10 == 0


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "n", 1, "r", 2) for i, t in rows], SCHEMA).repartition(parts)


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def texts(n, seed):
    rng = random.Random(seed)
    follows = {w: rng.sample("abcdefgh", 2) for w in "abcdefgh"}

    def one():
        w, said = rng.choice("abcdefgh"), []
        for _ in range(rng.randrange(1, 60)):
            said.append(w.upper() if rng.random() < 0.1 else w)
            if rng.random() < 0.2:
                said.append(rng.choice(["", "über", "x%d" % rng.randrange(200), "end."]) + "é" * rng.randrange(3))
            w = rng.choice(follows[w])
        return rng.choice([" ", "\n", "\t "]).join(said)

    return [(i, one()) for i in range(n)]


def tiny(seed=0, hidden=5):
    shape = gru.Shape(11, 4, 3, hidden)
    flat = gru.initial(shape, np.arange(1.0, 15.0))
    return shape, flat + np.random.default_rng(seed).normal(0, 0.2, len(flat)).astype(np.float32)


def test_probabilities_sum_to_one():
    shape, flat = tiny()
    net = gru.Network(shape, flat)
    states = np.random.default_rng(1).normal(size=(3, 5)).astype(np.float32)
    p = np.array([np.exp(net.output(states, np.full(3, t))[0]) for t in range(shape.n_words + shape.n_shapes)])
    unused = shape.word_classes * shape.size - shape.n_words
    assert unused == 1 and np.allclose(p.sum(0), 1, atol=1e-3) and (p > 0).all()


def test_gradient_by_differences():
    shape, flat = tiny()
    flat = flat.astype(np.float64)
    rng = np.random.default_rng(3)
    ids, first = rng.integers(0, 14, 40), np.array([0, 13, 14, 30, 40])
    lanes = gru.Lanes(ids, first, 2, 0)
    at, exists = next(lanes.windows(64))

    def loss(x, grad=None):
        net = gru.Network(shape, x)
        h = np.zeros((at.shape[1], 5))
        used, given = np.unique(lanes.given[at], return_inverse=True)
        given = given.reshape(at.shape)
        states, _, kept = net.run(given, lanes.begin[at], h, net.table(used), keep=True)
        logp, back = net.output(states[exists], lanes.target[at][exists], grad)
        if grad is not None:
            whole = np.zeros_like(states)
            whole[exists] = back
            net.backward(used, given, lanes.begin[at], kept, whole, grad)
        return -logp.sum()

    old, gru.f32 = gru.f32, np.float64
    try:
        g = np.zeros_like(flat)
        loss(flat, shape.split(g))
        for k in rng.choice(len(flat), 60, replace=False):
            e = np.zeros_like(flat)
            e[k] = 1e-4
            assert abs((loss(flat + e) - loss(flat - e)) / 2e-4 - g[k]) < 1e-4 * max(1, abs(g[k]))
    finally:
        gru.f32 = old


def test_a_window_tells_all_its_classes_at_once(monkeypatch):
    shape, flat = tiny()
    rng, told = np.random.default_rng(2), []
    states, target = rng.normal(size=(400, 5)).astype(np.float32), rng.integers(0, 14, 400)
    picked = gru.picked
    monkeypatch.setattr(gru, "picked", lambda x, pick: told.append(len(x)) or picked(x, pick))
    net = gru.Network(shape, flat)
    logp, _ = net.output(states, target, shape.split(np.zeros_like(flat)))
    assert told == [400, int((target < 11).sum())]  # not once for each class
    assert np.allclose(logp, net.output(states, target)[0], atol=1e-5)


def test_windows_and_lanes_do_not_change_the_likelihood():
    shape, flat = tiny()
    net, rng = gru.Network(shape, flat), np.random.default_rng(5)
    first = np.r_[0, np.cumsum(rng.integers(1, 50, 30))]
    ids = rng.integers(0, 14, first[-1])
    whole = gru.log_likelihood(net, net.table(), ids, first, 0, n_lanes=1, steps=10_000)
    for lanes, steps in ((1, 3), (7, 16), (64, 5)):
        assert np.allclose(gru.log_likelihood(net, net.table(), ids, first, 0, lanes, steps), whole, atol=1e-3)
    alone = [gru.log_likelihood(net, net.table(), ids[a:b], np.array([0, b - a]), 0)[0] for a, b in zip(first, first[1:])]
    assert np.allclose(alone, whole, atol=1e-3)


def plain(rows, vocab, flat):
    """Whole scores, word by word, from dictionaries."""
    learn = [t for i, t in rows if not out(i)]
    counts = Counter(w for t in learn for w in tokens(t))
    total, distinct = sum(counts.values()) + len(learn), len(counts) + bool(learn)
    scan = {w: textscan.scan(pa.array([w]), lower=True) for w in {w for _, t in rows for w in tokens(t)}}
    kind = {w: int(L.outlines(s)[0]) for w, s in scan.items()}
    token = {w: int(vocab.find(s, L.outlines(s))[0][0]) for w, s in scan.items()}
    groups = {}
    for w, c in counts.items():
        if token[w] > vocab.n_head:
            groups.setdefault(kind[w], []).append(c)
    net = gru.Network(vocab.shape(), flat)

    def inner(w):
        if token[w] <= vocab.n_head:
            return 0.0
        g = groups.get(kind[w], [])
        once, twice = g.count(1), g.count(2)
        d = (once + 0.5) / (once + 2 * twice + 1)
        return math.log10((counts[w] - d) / sum(g)) if counts[w] else math.log10(d * len(g) / sum(g)) if g else 0.0

    for i, t in rows:
        ws = tokens(t)
        ids = np.array([token[w] for w in ws] + [0])
        score = gru.log_likelihood(net, net.table(), ids, np.array([0, len(ids)]), 0)[0] / math.log(10) + sum(map(inner, ws))
        base = sum(math.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in [counts[w] for w in ws] + [len(learn)])
        yield i, out(i), len(ws) + 1, sum(counts[w] > 0 for w in ws) + bool(learn), total, base, score


@pytest.mark.parametrize("warm", [12, 100_000])
def test_scores_equal_plain_version(spark, monkeypatch, warm):
    for name, value in (("HEAD", 7), ("CLASS", 3), ("WARM", warm), ("SLICE", 900), ("SHARE", 1), ("LANES", 4)):
        monkeypatch.setattr(L, name, value)
    rows = texts(150, 1) + [(1000, None), (1001, ""), (1002, " \n "), (None, "a b only-here"), (None, None), (7, "a b c"), (7, "a b c")]
    rows += [(2000 + i, "never %d seen ünseen" % i) for i in range(30)] + [(3000, "a b c d " * 3000)]
    seen = {}
    train = L.train
    monkeypatch.setattr(L, "train", lambda docs, vocab: seen.setdefault("flat", seen.update(vocab=vocab) or train(docs, vocab)))
    got = L.score_all(frame(spark, rows), held()).collect()
    want = list(plain(rows, seen["vocab"], seen["flat"]))
    key = lambda r: (str(r[0]), r[2], r[5])
    assert len(got) == len(want) and any(r.held_out and r.n_known < r.n_tokens for r in got)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, -b[5]) and abs(a[6] - b[6]) < 1e-4 * max(1, -b[6])


def test_it_learns_what_follows(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARE", 1)
    monkeypatch.setattr(L, "LANES", 8)
    got = L.score_all(frame(spark, texts(3000, 9), 2), held()).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.1 * got[2]  # better by a quarter in perplexity and more


def test_nothing_to_learn_from_and_empty_table(spark):
    only = [i for i in range(200) if out(i)][:5]
    got = L.score_all(frame(spark, [(i, "a b") for i in only], 1), held()).collect()
    assert len(got) == 5 and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0.0 and r.score < 0 for r in got)
    assert L.score_all(frame(spark, [], 1), held()).count() == 0


def test_parts_of_long_documents_follow_the_token_before_them():
    ids, first = np.array([5, 6, 7, 8, 0, 9, 0, 4, 3, 2, 1, 7, 6, 0]), np.array([0, 5, 7, 14])
    lanes = gru.Lanes(ids, first, 2, 0, 3)
    before = {0: 0, 5: 0, 7: 0, **{i: ids[i - 1] for i in (1, 2, 3, 4, 6, 8, 9, 10, 11, 12, 13)}}
    assert sorted(zip(lanes.given.tolist(), lanes.target.tolist())) == sorted((int(before[i]), int(ids[i])) for i in range(14))
    assert lanes.begin.sum() == 2 + 1 + 3 and max(np.bincount(lanes.doc)) == 3


def test_every_training_document_teaches(spark):
    rows = [(i, "a b c d " * 30) for i in range(6)]
    vocab = L.vocabulary(L.word_counts(frame(spark, rows)).cache(), len(rows))
    start = gru.initial(vocab.shape(), vocab.frequencies())
    for row in rows:
        assert not np.array_equal(L.train(frame(spark, [row], 1).select("doc_id", "text"), vocab), start)
