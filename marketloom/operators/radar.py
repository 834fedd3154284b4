"""Alert rules, ranking and compression."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import f2, lookup, nz, rnd
from ..sources.landing import top_rank
from .kg import contained

c = F.col
# Rule thresholds and vocabularies.
TECHNICAL = ["TA_BSNM_CONFLUENCE", "TA_BSNM_BEAR_CONFLUENCE", "CHART_PATTERN", "REGIME_ALERT"]
BULLISH_EVENTS = ["earnings_beat", "partnership", "product_launch", "debt_upgrade"]
BEARISH_EVENTS = ["earnings_miss", "regulatory", "debt_downgrade"]
ALERT = ["ticker", "alert_type", "title", "body", "strength", "direction", "suggested_action", "evidence"]


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def signed2(x: Column) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), f2(x))


def _alert(test, kind, title, body, strength, direction, action, evidence) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(test, F.struct(
        lit(kind).alias("alert_type"), title.alias("title"), body.alias("body"), strength.alias("strength"),
        lit(direction).alias("direction"), lit(action).alias("suggested_action"), evidence.alias("evidence")))


def _emit(d: DataFrame, *alerts: Column) -> DataFrame:
    """Rows of every alert whose test holds: one pass over the input for all rules."""
    return d.select("ticker", F.explode(F.array_compact(F.array(*alerts))).alias("a")).select("ticker", "a.*")


def candidates(signals: DataFrame, k: int = 30) -> DataFrame:
    """Symbols worth a sentiment pass: top k by absolute score."""
    return signals.orderBy(F.abs("score").desc(), "ticker").limit(k)


def joined(signals: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Signals with their news sentiment; 0 where none was read."""
    s = sentiment.select("ticker", c("score").alias("news"), "headline_summary")
    return signals.join(s, "ticker", "left").withColumn("news", nz(c("news"))).withColumn("headline_summary", nz(c("headline_summary"), ""))


def _confluence() -> list[Column]:
    shapes = F.transform(F.slice("patterns", 1, 2), lambda p: F.concat(F.lit("Pattern: "), p["name"], F.lit(" — "), p["explanation"]))
    up = _alert((c("suggested_action") == "BUY") & (c("news") > 0.25),
                "TA_BSNM_CONFLUENCE", _text(c("ticker"), ": Technical + News Confluence"),
                _text("Strong TA buy signal (score ", f2(c("score")), ", regime: ", c("regime"), ") confirmed by positive news sentiment (",
                      signed2(c("news")), "). ", c("headline_summary")),
                F.least((c("confidence") + c("news")) / 2 + 0.1, F.lit(1.0)), "bullish", "BUY",
                F.concat(F.array(_text("TA score: ", f2(c("score")), " vs threshold ", f2(c("threshold"))),
                                 _text("Regime: ", c("regime"), " — ", c("regime_desc")),
                                 _text("Business sentiment: ", signed2(c("news")))), shapes))
    down = _alert((c("suggested_action") == "SELL") & (c("news") < -0.25),
                  "TA_BSNM_BEAR_CONFLUENCE", _text(c("ticker"), ": Bearish Signal — Consider Exiting"),
                  _text("TA sell signal (score ", f2(c("score")), ") combined with negative news (", signed2(c("news")), "). ", c("headline_summary")),
                  F.least((c("confidence") + F.abs("news")) / 2, F.lit(1.0)), "bearish", "SELL",
                  F.array(_text("TA score: ", f2(c("score")), " below zero"), _text("Business sentiment: ", signed2(c("news")))))
    return [up, down]


def _pattern() -> Column:
    action = lookup(c("p.direction"), {"bullish": "BUY", "bearish": "SELL"}, "WATCH")
    return _alert(c("p.strength") >= 0.75, "CHART_PATTERN", _text(c("ticker"), ": ", c("p.name"), " Detected"), c("p.explanation"),
                  c("p.strength") * F.greatest(c("confidence"), F.lit(0.65)), c("p.direction"), action,
                  F.array(c("p.explanation"), _text("Regime: ", c("regime")), _text("Last close: ₹", f2(c("last_close")))))


def _regime() -> Column:
    return _alert(c("regime").isin("BREAKOUT", "WHALE"), "REGIME_ALERT", _text(c("ticker"), ": ", c("regime"), " Regime Detected"), c("regime_desc"),
                  F.when(c("regime") == "WHALE", 0.7).otherwise(0.65), F.when(c("score") > 0, "bullish").otherwise("bearish"), "WATCH",
                  F.array(c("regime_desc"), _text("TA score: ", f2(c("score")))))


def _news(score: str = "score", ta: str = "ta") -> Column:
    s = c(score)
    action = F.when(c(ta) == "HOLD", "WATCH").when(s > 0, "BUY").otherwise("SELL")
    return _alert(F.abs(s) >= 0.5, "STRONG_NEWS", _text(c("ticker"), ": Strong ", F.when(s > 0, "Positive").otherwise("Negative"), " News Flow"),
                  c("headline_summary"), F.least(F.abs(s), F.lit(1.0)) * 0.7, F.when(s > 0, "bullish").otherwise("bearish"), action,
                  F.concat(F.slice("top_headlines", 1, 3), F.array(_text("News sentiment score: ", signed2(s)),
                                                                   _text("Articles analysed: ", c("articles_found").cast("string")))))


def confluence(d: DataFrame) -> DataFrame:
    """Signal and news agree."""
    return _emit(d, *_confluence())


def pattern_alerts(d: DataFrame) -> DataFrame:
    """Chart patterns of strength .75 or more."""
    return _emit(d.withColumn("p", F.explode("patterns")), _pattern())


def regime_alerts(d: DataFrame) -> DataFrame:
    """Breakout and institutional-activity regimes."""
    return _emit(d, _regime())


def news_alerts(sentiment: DataFrame, signals: DataFrame) -> DataFrame:
    """Strong stand-alone news flow."""
    strong = sentiment.where(F.abs("score") >= 0.5)
    return _emit(strong.join(signals.select("ticker", c("suggested_action").alias("ta")), "ticker", "left"), _news())


def signal_alerts(signals: DataFrame, sentiment: DataFrame) -> DataFrame:
    """All alerts that need only the signal and sentiment record of a ticker (R02–R06), from one
    join and one pass. Signals carry their best pattern only, so it is read by position."""
    s = sentiment.select("ticker", c("score").alias("news_score"), "headline_summary", "top_headlines", "articles_found")
    d = signals.join(s, "ticker", "full_outer").withColumn("news", nz(c("news_score")))
    d = d.withColumn("p", F.get("patterns", F.lit(0))).withColumn("ta", c("suggested_action"))
    d = d.withColumn("headline_summary", nz(c("headline_summary"), ""))
    return _emit(d, *_confluence(), _pattern(), _regime(), _news("news_score"))


def linked(edges: DataFrame, nodes: DataFrame, companies: DataFrame, kind: str) -> DataFrame:
    """Nodes of one type a company points to (J02); the type filter reaches the node scan."""
    t = nodes.where(c("entity_type") == kind).select(c("id").alias("to_id"), "canonical_name", "description", "attributes")
    return edges.select("from_id", "to_id").join(t, "to_id").join(companies.select(c("company_id").alias("from_id"), "ticker"), "from_id")


def insider_alerts(trades: DataFrame) -> DataFrame:
    """Insider trades of ten crores or more."""
    a = lambda k: F.element_at("attributes", k)
    value, kind = a("value_crores").try_cast("double"), nz(a("trade_type"), "")
    d = trades.withColumns({"value": value, "kind": kind, "trader": nz(a("trader_name"), "Unknown"),
                            "qty": a("quantity").try_cast("double"), "px": a("price").try_cast("double")}).where(c("value") >= 10)
    buy = F.contains(F.lower("kind"), F.lit("buy")) | F.contains(F.lower("kind"), F.lit("bulk"))
    words = F.replace("kind", F.lit("_"), F.lit(" "))
    known = c("qty").isNotNull() & c("px").isNotNull()
    body = F.when(known, _text(c("trader"), F.when(buy, " bought ").otherwise(" sold "), "₹", F.format_string("%.1f", rnd(c("value"), 1)), " Cr worth of ",
                               c("ticker"), " (", F.format_string("%.0f", rnd(c("qty"), 0)), " shares @ ₹", f2(c("px")), ")")).otherwise(
        _text(c("trader"), " executed a significant ", words, "."))
    return _emit(d, _alert(F.lit(True), "INSIDER_TRADE", _text(c("ticker"), ": Significant ", F.initcap(words)), body,
                   F.least(c("value") / 100, F.lit(0.9)), F.when(buy, "bullish").otherwise("bearish"), "WATCH",
                   F.array(_text("Trade type: ", c("kind")), _text("Trader: ", c("trader")),
                           _text("Value: ₹", F.format_string("%.1f", rnd(c("value"), 1)), " Cr"))))


def event_alerts(events: DataFrame) -> DataFrame:
    """Corporate events of magnitude .6 or more."""
    d = events.withColumns({"magnitude": nz(F.element_at("attributes", "magnitude").try_cast("double")),
                            "event_type": nz(F.element_at("attributes", "event_type"), "other")}).where(c("magnitude") >= 0.6)
    way = F.when(c("event_type").isin(BULLISH_EVENTS), "bullish").when(c("event_type").isin(BEARISH_EVENTS), "bearish").otherwise("neutral")
    return _emit(d, _alert(F.lit(True), "CORPORATE_EVENT", _text(c("ticker"), ": ", c("canonical_name")), F.coalesce("description", "canonical_name"),
                   c("magnitude") * 0.8, way, "WATCH",
                   F.array(_text("Event type: ", c("event_type")), _text("Magnitude: ", f2(c("magnitude"))))))


def union(*parts: DataFrame) -> DataFrame:
    """Union of alert streams by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_alerts(alerts: DataFrame) -> DataFrame:
    """Strongest alert per (ticker, title) (R09); repeated alerts are cut before the exchange."""
    return top_rank(alerts, ["ticker", "title"], [c("strength").desc(), c("alert_type"), c("body")], 1)


def category(kind: Column) -> Column:
    return F.when(kind.isin(TECHNICAL), "technical").otherwise("news_market")


def cards(alerts: DataFrame) -> DataFrame:
    """One card per (ticker, category): the strongest alert, all titles as evidence."""
    d = alerts.withColumn("category", category(c("alert_type")))
    rest = F.struct(*[x for x in ALERT if x not in ("ticker", "strength", "alert_type")])
    g = d.groupBy("ticker", "category").agg(
        F.min_by(rest, F.struct(-c("strength"), c("title"))).alias("b"), F.max("strength").alias("strength"),
        F.count(F.lit(1)).alias("alert_count"), F.array_sort(F.collect_set("title")).alias("titles"))
    return g.select("ticker", "category", "b.title", "b.body", "b.suggested_action", "b.direction", "strength",
                    F.when(c("alert_count") > 1, c("titles")).otherwise(c("b.evidence")).alias("evidence"), "alert_count")


def top_alerts(alerts: DataFrame, k: int) -> DataFrame:
    """k strongest alerts per ticker."""
    return top_rank(alerts, ["ticker"], [c("strength").desc(), c("title")], k)


def ordered_union(*lists: DataFrame, key: str = "symbol", pos: str = "pos") -> DataFrame:
    """Distinct union that keeps first-seen order (U02): (key, list, pos)."""
    tagged = [d.select(key, F.lit(n).alias("list"), c(pos).alias("pos")) for n, d in enumerate(lists)]
    return union(*tagged).groupBy(key).agg(F.min(F.struct("list", "pos")).alias("o")).select(key, "o.list", "o.pos")


def portfolio(holdings: DataFrame, watchlist: DataFrame, signals: DataFrame, alerts: DataFrame, k: int = 20) -> DataFrame:
    """Portfolio rows: holdings first, then the watchlist, k in all, with signals and alerts."""
    who = ordered_union(holdings, watchlist).orderBy("list", "pos").limit(k)
    a = alerts.groupBy(c("ticker").alias("symbol")).agg(F.array_sort(F.collect_set("title")).alias("alerts"))
    s = signals.select(c("ticker").alias("symbol"), "suggested_action", "score")
    return (who.join(s, "symbol", "left").join(a, "symbol", "left")
            .join(holdings.select("symbol", "quantity", "avg_cost"), "symbol", "left"))


def intel(signals: DataFrame, alerts: DataFrame, nodes: DataFrame, companies: DataFrame, k_alerts: int = 8, k_hits: int = 6) -> DataFrame:
    """Everything known about a ticker in one row."""
    a = top_alerts(alerts, k_alerts).groupBy("ticker").agg(F.array_sort(F.collect_list("title")).alias("alerts"))
    names = nodes.select(F.explode(F.array_union(F.array(F.lower("canonical_name")), F.transform("aliases", lambda x: F.lower(x)))).alias("hay"), "id", "confidence")
    t = signals.select("ticker").join(companies.select("ticker", F.lower("name").alias("needle")), "ticker")
    inside = contained(t.select(c("needle").alias("text")), names.select(c("hay").alias("text")), [])
    hits = t.join(inside, "needle").join(names, "hay").select("ticker", "id", "confidence").distinct()
    hits = top_rank(hits, ["ticker"], [c("confidence").desc(), c("id")], k_hits)
    h = hits.groupBy("ticker").agg(F.array_sort(F.collect_list("id")).alias("entities"))
    return signals.join(companies, "ticker", "left").join(a, "ticker", "left").join(h, "ticker", "left")


def movers(moves: DataFrame, k: int = 3) -> DataFrame:
    """Top and bottom k by percent change with a role (R15): two bounded top-k reports."""
    up = moves.orderBy(c("pct_change").desc(), "ticker").limit(k).withColumn("role", F.lit("gainer"))
    down = moves.orderBy(c("pct_change").asc(), c("ticker").desc()).limit(k).withColumn("role", F.lit("loser"))
    return up.union(down.join(up.select("ticker"), "ticker", "left_anti").select(*up.columns))


def fill_insights(insights: DataFrame, signals: DataFrame) -> DataFrame:
    """First insight per upper-cased ticker, numbers filled from signals."""
    d = insights.withColumn("ticker", F.upper(nz(c("ticker"), ""))).where(c("ticker") != "")
    first = top_rank(d, ["ticker"], [c("pos")], 1)
    s = signals.select("ticker", c("pct_change").alias("_p"), c("last_close").alias("_l"), c("score").alias("_s"), c("suggested_action").alias("_a"))
    return first.join(s, "ticker", "left").select(
        "ticker", "summary", F.coalesce("pct_change", "_p").alias("pct_change"), F.coalesce("last_close", "_l").alias("last_close"),
        F.coalesce("score", "_s").alias("score"), F.coalesce("action", "_a", F.lit("HOLD")).alias("action"))


def overview(ranked: DataFrame, alerts: DataFrame, k_signals: int = 5, k_alerts: int = 3) -> DataFrame:
    """Top signals by conviction and top alerts as one small report."""
    s = ranked.orderBy(c("conviction").desc(), "ticker").limit(k_signals).select(F.lit("signal").alias("section"), "ticker", c("signal").alias("label"), c("conviction").alias("value"))
    a = alerts.orderBy(c("strength").desc(), "ticker", "title").limit(k_alerts).select(F.lit("alert"), "ticker", c("title"), c("strength"))
    return s.union(a)


def ticker_context(mentioned: DataFrame, signals: DataFrame, alerts: DataFrame, k: int = 2) -> DataFrame:
    """Signal line and up to k alerts per mentioned symbol (R18). mentioned: (id, symbol)."""
    a = top_alerts(alerts, k).groupBy("ticker").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat("title", F.lit(": "), F.substring("body", 1, 120)))), "; ").alias("alerts"))
    line = _text(c("ticker"), ": ", c("suggested_action"), " score ", f2(c("score")), " regime ", c("regime"))
    s = signals.select("ticker", line.alias("line")).join(a, "ticker", "left")
    return mentioned.join(s.withColumnRenamed("ticker", "symbol"), "symbol").select("id", "symbol", "line", nz(c("alerts"), "").alias("alerts"))
