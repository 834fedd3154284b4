"""News, radar, watch and veto boundaries."""
from pyspark.sql import functions as F

from marketloom.operators import news as N, radar as R, signals as S, watches as W


def test_news_weights_and_fallbacks(spark):
    rows = [("T", "marketaux", "a", "2024-01-31", 1), ("T", "newsapi", "b", "2024-01-30", 2), ("T", "else", "c", "2023-01-01", 3),
            ("T", "newsdata", "d", "not a date", 4), ("T", "marketaux", "e", "2024-01-29", 5)]
    d = spark.createDataFrame(rows, "ticker string, source string, title string, published_at string, doc_id long")
    got = {r.doc_id: r.w for r in d.select("doc_id", N.weight(F.col("source"), F.col("published_at"), F.lit("2024-01-31").cast("date")).alias("w")).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {1: 1.0, 2: 0.56, 3: 0.25, 4: 0.25, 5: 0.5}


def test_equal_scores_cancel_weights(spark):
    d = spark.createDataFrame([("T", 0.3, w) for w in (1.0, 0.2, 0.5)], "ticker string, raw_score double, weight double")
    assert N.sentiment(d).first().score == 0.3


def test_title_dedup(spark):
    rows = [("T", "newsdata", " Hello ", 1), ("T", "marketaux", "hello", 2), ("T", "newsapi", "", 3), ("U", "newsapi", "HELLO", 4)]
    d = spark.createDataFrame(rows, "ticker string, source string, title string, doc_id long")
    assert sorted(r.doc_id for r in N.dedup_titles(d).collect()) == [2, 4]


def signal(spark, rows):
    return spark.createDataFrame(
        [(t, a, s, 0.7, 1.5, "WHALE", "text", 10.0, float(n), "sum", [("Doji", "neutral", "x", p)]) for t, a, s, n, p in rows],
        "ticker string, suggested_action string, score double, confidence double, threshold double, regime string, regime_desc string, "
        "last_close double, news double, headline_summary string, patterns array<struct<name:string,direction:string,explanation:string,strength:double>>")


def test_confluence_edges(spark):
    d = signal(spark, [("A", "BUY", 2.0, 0.25, 0.75), ("B", "BUY", 2.0, 0.26, 0.74), ("C", "SELL", -2.0, -0.25, 0.9), ("D", "SELL", -2.0, -0.3, 0.1)])
    assert sorted(r.ticker for r in R.confluence(d).collect()) == ["B", "D"]
    assert sorted(r.ticker for r in R.pattern_alerts(d).collect()) == ["A", "C"]
    assert R.regime_alerts(d).count() == 4


def test_one_pass_equals_separate_rules(spark):
    d = signal(spark, [("A", "BUY", 2.0, 0, 0.8), ("B", "HOLD", 0.0, 0, 0.1)]).drop("news", "headline_summary")
    sent = spark.createDataFrame([("A", 0.5, "s", ["h"], 3), ("B", -0.5, "s", ["h"], 1), ("Z", 0.9, "s", [], 1)],
                                 "ticker string, score double, headline_summary string, top_headlines array<string>, articles_found long")
    j = R.joined(d, sent)
    want = R.union(R.confluence(j), R.pattern_alerts(j), R.regime_alerts(j), R.news_alerts(sent, d))
    got = R.signal_alerts(d, sent)
    key = lambda x: sorted((r.ticker, r.alert_type, r.body, round(r.strength, 6), r.suggested_action) for r in x.collect())
    assert key(got) == key(want)
    assert ("B", "STRONG_NEWS") in {(r.ticker, r.alert_type) for r in got.where("suggested_action = 'WATCH'").collect()}


def test_alert_dedup_and_cards(spark):
    rows = [("A", "CHART_PATTERN", "t", "b", 0.5), ("A", "CHART_PATTERN", "t", "c", 0.9), ("A", "STRONG_NEWS", "n", "b", 0.4), ("A", "REGIME_ALERT", "r", "b", 0.7)]
    d = spark.createDataFrame([(*r, "neutral", "WATCH", ["e"]) for r in rows],
                              "ticker string, alert_type string, title string, body string, strength double, direction string, suggested_action string, evidence array<string>")
    u = R.distinct_alerts(d)
    assert u.count() == 3
    cards = {r.category: r for r in R.cards(u).collect()}
    assert cards["technical"].title == "t" and cards["technical"].alert_count == 2 and cards["technical"].evidence == ["r", "t"]
    assert cards["news_market"].evidence == ["e"]


def test_insider_and_event_thresholds(spark):
    rows = [("A", {"trade_type": "bulk_buy", "value_crores": "10"}), ("B", {"trade_type": "sell", "value_crores": "9.99"}), ("C", {"trade_type": "block", "value_crores": "95"})]
    d = spark.createDataFrame(rows, "ticker string, attributes map<string,string>")
    got = {r.ticker: (r.strength, r.direction) for r in R.insider_alerts(d).collect()}
    assert got == {"A": (0.1, "bullish"), "C": (0.9, "bearish")}
    ev = spark.createDataFrame([("A", "x", None, {"magnitude": "0.6"}), ("B", "y", None, {"magnitude": "0.59"})],
                               "ticker string, canonical_name string, description string, attributes map<string,string>")
    assert [r.ticker for r in R.event_alerts(ev).collect()] == ["A"]


def test_veto(spark):
    sig = spark.createDataFrame([("A.NS", "BUY", 2.0, 1.5), ("B", "BUY", 2.0, 1.5), ("C.BO", "HOLD", 0.5, 1.5), ("D", "SELL", -1.0, 0.0)],
                                "ticker string, suggested_action string, score double, threshold double")
    biz = spark.createDataFrame([("A", -0.4), ("B", -0.39), ("C", 0.35)], "ticker string, sentiment double")
    got = {r.ticker: r for r in S.veto(sig, biz, biz.limit(0)).collect()}
    assert [got[k].final_action for k in ("A.NS", "B", "C.BO", "D")] == ["Hold", "Buy", "Buy", "Sell"]
    assert got["A.NS"].reason == "Hard Business Veto (b=-0.400)" and got["D"].confidence == 1e6


def test_watch_predicates(spark):
    cases = [("price", ">", 10.0, None, 10.0, False), ("price", ">=", 10.0, None, 10.0, True), ("price", "==", 10.0, None, 10.009, True),
             ("price", "==", 10.0, None, 10.02, False), ("action", "==", None, "buy", 0.0, True), ("action", ">", None, "buy", 0.0, False),
             ("volume", ">", 0.0, None, 5.0, False), ("price", "~", 0.0, None, 5.0, False), ("ta_score", "<", 0.0, None, 1.0, False)]
    d = spark.createDataFrame([(k, m, o, n, s, p, None, None, "BUY") for k, (m, o, n, s, p, _) in enumerate(cases)],
                              "k int, metric string, operator string, threshold_num double, threshold_str string, price double, pct_change double, score double, action string")
    got = {r.k: r.m for r in d.select("k", W.met().alias("m")).collect()}
    assert got == {k: x[-1] for k, x in enumerate(cases)}


def test_one_decimal_text_is_rounded_by_the_exact_value(spark):
    import random

    from marketloom.functions.numeric import f1

    rng = random.Random(5)
    values = [(2 * k + 1) / 20 for k in range(3000)] + [0.0, 3.25, 3.75, 3.45, 0.3, 0.29999999999999998, 99.95] + [rng.uniform(0, 100) for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", f1(F.col("v")).alias("t")).collect()
    assert [r for r in got if r.t != "%.1f" % r.v] == []
