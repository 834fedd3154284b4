import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from llm.helpers import awkward, empty
from marketloom.llm import quality_model, quality_rules, queries
from pyspark.sql import functions as F


def labelled(spark, n=400):
    rng, rows, labels = random.Random(1), [], []
    for i in range(n):
        w = ["".join(rng.choice("abcdeionst") for _ in range(rng.randrange(2, 10))) for _ in range(rng.randrange(30, 200))]
        good = i % 4 > 0
        rows.append((i, " ".join(w) + "." if good else "!! ".join(x.upper() for x in w[:9] * 8)))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels + [(10**6, 1), (3, None)], "doc_id long, quality int"), dict(labels)


def test_classifier_separates_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    rows = queries.judged(quality_model.score_all(docs, labels, "quality", held_out), held_out).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 400 and len(held) > 80 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    kept = {r.doc_id for r in quality_model.keep_good(docs, labels).collect()}
    assert len(kept ^ {i for i, y in truth.items() if y}) <= 4


def test_sums_give_the_textbook_model(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, quality_model.N_STATS)) * np.arange(1, quality_model.N_STATS + 1), rng.integers(0, 2, 300)
    x[y == 1] += 2
    model = quality_model.fit(spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, y)], "stats array<double>, label int").repartition(3), 0.0, 0.0)
    for k in (0, 1):
        cov = np.cov(x[y == k].T, bias=True) + quality_model.RIDGE * np.eye(quality_model.N_STATS)
        assert np.allclose(model.means[k], x[y == k].mean(0)) and np.allclose(model.whiten[k] @ cov @ model.whiten[k].T, np.eye(quality_model.N_STATS), atol=1e-6)
        assert model.half_logdet[k] == pytest.approx(np.linalg.slogdet(cov)[1] / 2)


def test_classifier_without_labels_and_rows(spark):
    docs, labels, _ = labelled(spark, 20)
    none = quality_model.score_all(awkward(spark), labels.filter("false"))
    assert none.count() == 12 and {r.score for r in none.collect()} == {0.5}
    one = quality_model.score_all(docs, labels.filter("quality = 1"))
    assert {r.score > 0.99 for r in one.collect()} == {True}
    assert quality_model.score_all(empty(spark), labels).count() == 0


def test_statistics_handle_null():
    x = quality_model.statistics(pa.array([None, "", "a b c", "a " * 3000]))
    assert np.isfinite(x).all() and (x[0] == x[1]).all()


def plain_counts(text):
    w = text.split()
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.split()]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_base_counts_equal_plain_version(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("a b cc dd $ ## é".split()) + rng.choice(["", "", "\n"]) for _ in range(rng.randrange(80))) for _ in range(60)]
    texts += ["", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\n\nx\n \nx"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in quality_rules.base_counts(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(texts[r.doc_id])


def test_rules_on_awkward_rows(spark):
    docs = awkward(spark)
    found = quality_rules.verdicts(docs)
    assert found.count() == docs.count() and found.filter("kept AND base_failed").count() == 0
    assert quality_rules.verdicts(empty(spark)).count() == 0


def test_fences_follow_the_group(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(*((2, 6) if i % 2 else (14, 20))))) for _ in range(80)), "en", f"s{i % 2}") for i in range(600)]
    short = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(80))
    rows += [(999, short, "en", "s0"), (1001, " ".join("y" * 90 + str(i) for i in range(80)), "en", "s1")]
    kept = {r.doc_id for r in quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == set(range(600))  # short words do not belong to the source of long ones


def prose(rng, n=80):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.mark.parametrize("n,percent", [(400, 0), (400, 10), (400, 30), (20, 10), (199, 25), (201, 25)])
def test_spam_is_rejected_however_much_a_source_holds(spark, n, percent):
    rng, bad = random.Random(n + percent), set(range(n * percent // 100))
    rows = [(i, prose(rng) + " $$ %% ##" * 12 if i in bad else prose(rng), "en", "s") for i in range(n)]
    rows += [(1000 + i, prose(rng), "en", "other") for i in range(100)]
    kept = {r.doc_id for r in quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == {r[0] for r in rows} - bad


def test_equal_values_leave_room(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng) + ("" if i % 25 else "\nsame line\nsame line"), "en", "s") for i in range(300)]  # all quartiles of repeated lines are 0
    rows += [(999, prose(rng) + "\nx" * 40, "en", "s")]
    kept = {r.doc_id for r in quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == set(range(300))


def test_values_at_a_fence_stay(spark):
    cells = spark.createDataFrame([("en", "s", "symbols", 0, 100)], "lang string, source string, name string, cell long, n long")
    assert quality_rules.fences(cells).first().symbols_at_most == 200
    rows = [(i, " ".join(["word"] * 3 + [f"w{j}" for j in range(97)]), "en", "s") for i in range(100)]
    rows += [(200 + k, " ".join(["$" * (20 + k)] + [f"w{j}" for j in range(99)]), "en", "s") for k in (0, 1)]  # 200 and 210 thousandths
    kept = {r.doc_id for r in quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == set(range(100)) | {200}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
