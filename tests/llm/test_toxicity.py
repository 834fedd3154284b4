import itertools
import random

import numpy as np
import pyarrow as pa
from llm.helpers import awkward, empty
from marketloom.llm import queries, toxicity
from pyspark.sql import functions as F

BAD = ("blockhead", "nitwit", "scoundrel", "dunce")


def test_norms_and_table_equal_the_kernel():
    def spectrum(word):
        out, kinds = {}, toxicity._KIND[list(word.encode())]
        for i, j, k in itertools.combinations(range(len(kinds)), 3):
            if kinds[i] and kinds[j] and kinds[k]:
                out[kinds[i], kinds[j], kinds[k]] = out.get((kinds[i], kinds[j], kinds[k]), 0) + toxicity.DECAY ** (k - i + 1)
        return out

    def kernel(a, b):
        return sum(v * spectrum(b).get(k, 0) for k, v in spectrum(a).items())

    marks, words = ["nitwit", "dunce", "aaaa"], ["nit-wit", "nitwits", "dunces", "xyz", "aaa"]
    space, kinds = toxicity.Landmarks(marks), toxicity._kinds_of(words)
    assert np.allclose(toxicity.norms(kinds), [np.sqrt(kernel(w, w)) for w in words])
    assert (toxicity.least_norms(kinds) <= toxicity.norms(kinds) + 1e-9).all()
    gram = np.array([[kernel(a, b) / np.sqrt(kernel(a, a) * kernel(b, b)) for b in marks] for a in marks])
    value = np.array([[kernel(a, b) / np.sqrt(kernel(a, a) * kernel(b, b)) for b in marks] for a in words])
    assert np.allclose(space.map(kinds) @ space.map(kinds).T, value @ np.linalg.inv(gram) @ value.T, atol=1e-4)
    w = np.arange(1.0, space.root.shape[1] + 1)
    assert np.allclose(toxicity.gather(kinds, space.table(w)) / toxicity.norms(kinds), space.map(kinds) @ w, atol=1e-4)


def corpus(spark, n=900):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(("ta", "ro", "mi", "lek", "sun", "dor", "ve", "pal")) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(5, 80))]
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(("", ".", "s")))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels + [(5, None)], "doc_id long, toxic int")


def test_insults_and_their_variants_are_found(spark):
    rows, docs, labels = corpus(spark)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = queries.judged(toxicity.score_all(docs, labels, "toxic", held_out), held_out).collect()
    assert len(found) == len(rows) and np.mean([r.predicted == (r.doc_id % 5 == 0) for r in found if r.held_out]) > 0.98
    machine = toxicity.train(docs, labels)
    texts = ["you n-i-t-w-i-t there", "what a b l o c k h e a d", "Scoun*drel!", "DUNCE", "nit.wit", "talek " * 3000 + "duunce", "talek romi sunve", None, "", "..."]
    assert (machine.score(pa.array(texts)) >= 0.5).tolist() == [True] * 6 + [False] * 4


def test_many_rare_insults_are_learnt(spark):
    """100 insults of equal frequency, each in a hundredth of the toxic documents, beside a word that all hold."""
    rng = random.Random(12)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    bad = [make("bcdfghjkz", 9) for _ in range(100)]
    clean = [make("aeilmnorstu", rng.randrange(3, 8)) for _ in range(400)]
    rows, labels = [], []
    for i in range(9000):
        w = ["the", *rng.choices(clean, k=12)]
        if i % 6 == 0:
            w.insert(rng.randrange(len(w)), bad[i // 6 % 100])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(docs, known)
    assert machine is not None
    assert (machine.score(pa.array([f"you {x} there" for x in bad])) >= 0.5).all()
    assert (machine.score(pa.array([f"you {x} there" for x in clean])) < 0.5).all()


def test_awkward_rows(spark):
    rows, docs, labels = corpus(spark, 200)
    none = toxicity.score_all(awkward(spark), labels.filter("toxic = 0"))
    assert none.count() == 12 and {r.score for r in none.collect()} == {0.0}
    assert toxicity.score_all(empty(spark), labels).count() == 0
    assert toxicity.score(awkward(spark), toxicity.train(docs, labels)).filter("score >= 0.5").count() == 0
