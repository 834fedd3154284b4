"""What the containment search cuts and moves."""
import numpy as np

from marketloom.operators import kg as K


def table(spark, texts, name):
    return spark.createDataFrame([("k", t) for t in texts], f"kind string, {name} string")


def test_texts_are_cut_only_into_grams_that_needles_ask_for(spark, monkeypatch):
    cut, grams = [], K._grams

    def noted(t, lengths):
        cut.append(list(lengths))
        return grams(t, lengths)

    monkeypatch.setattr(K, "_grams", noted)
    monkeypatch.setattr(K, "GRAM_GROUP", 20)
    hay = [f"customer {k:09d}" for k in range(300)]
    needles = [f"stomer {k:09d}" for k in range(0, 300, 7)]
    d = K.inside(table(spark, needles, "needle"), table(spark, hay, "hay"), ["kind"])
    assert sorted((r.needle, r.hay) for r in d.collect()) == sorted((n, h) for n in needles for h in hay if n in h)
    assert cut == [[3], [8]]


def test_texts_move_only_under_grams_that_needles_chose(spark):
    hay = [f"customer {k:09d}" for k in range(300)]
    d = K.inside(table(spark, ["000000007"], "needle"), table(spark, hay, "hay"), ["kind"])
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    assert [r.hay for r in d.collect()] == ["customer 000000007"]


def test_needles_of_all_lengths_and_none(spark, monkeypatch):
    monkeypatch.setattr(K, "GRAM_GROUP", 3)
    rng = np.random.default_rng(5)
    word = lambda k: "".join("ab c"[j] for j in rng.integers(0, 4, k))
    hay = sorted({word(int(k)) for k in rng.integers(1, 30, 120)})
    needles = sorted({word(int(k)) for k in rng.integers(1, 13, 120)} | {h[2:14] for h in hay if len(h) > 4} | {"", "zzzzzzzzzz", "aaaaaaaaaaaaaa"})
    for light in (100_000, 0):
        monkeypatch.setattr(K, "LIGHT", light)
        d = K.inside(table(spark, needles, "needle"), table(spark, hay, "hay"), ["kind"])
        assert sorted((r.needle, r.hay) for r in d.collect()) == sorted((n, h) for n in needles for h in hay if n and n in h)
    assert K.inside(table(spark, [""], "needle"), table(spark, hay, "hay"), ["kind"]).count() == 0
    assert K.inside(table(spark, needles, "needle"), table(spark, [], "hay"), ["kind"]).count() == 0
