"""News, sentiment and radar queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.numeric import day, f2, lookup, nz, rnd
from ..operators import kg as K, news as N, patterns as P, radar as R, signals as S
from ..sources import landing as L
from ..sources.tables import AS_OF
from .oracle import fragment
from .registry import query
from .source_queries import pct_moves

c, e = F.col, F.expr
PRV = "CASE source WHEN 'marketaux' THEN 0 WHEN 'newsapi' THEN 1 WHEN 'newsdata' THEN 2 ELSE 3 END"

fragment("scr", "SELECT doc_id, CAST(max((2*quality-1)*(1-toxic)) AS DOUBLE) AS raw FROM labels GROUP BY doc_id")
fragment("artw", f"""SELECT a.*, coalesce(s.raw,0) AS raw, {PRV} AS prv,
 CASE source WHEN 'marketaux' THEN 1.0 WHEN 'newsapi' THEN 0.7 WHEN 'newsdata' THEN 0.5 ELSE 0.5 END::DOUBLE
 * CASE least(date_diff('day', CAST(published_at AS DATE), DATE '{AS_OF}'), 2) WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.5 END::DOUBLE AS w
FROM art a LEFT JOIN scr s USING (doc_id)""")
fragment("sent0", "SELECT ticker, R4(sum(raw*w)/sum(w)) AS score, count(*) AS n FROM artw GROUP BY ticker")
fragment("heads", "SELECT ticker, string_agg(title, '|' ORDER BY prv, doc_id) AS heads, first(title ORDER BY prv, doc_id) AS head1 FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY prv, doc_id) AS r FROM artw) WHERE r<=5 GROUP BY ticker")
fragment("syms", "SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS ticker, s_suppkey FROM supplier")
fragment("sent", """SELECT y.ticker, coalesce(s.score,0) AS score, coalesce(s.n,0) AS n, coalesce(h.heads,'') AS heads,
 CASE WHEN s.n IS NULL THEN 'No news found.' ELSE CAST(s.n AS VARCHAR) || ' articles; latest: ' || h.head1 END AS summary
FROM syms y LEFT JOIN sent0 s USING (ticker) LEFT JOIN heads h USING (ticker)""")


def items(m):
    return N.weighted(m.articles, m.item_scores, AS_OF)


def records(m):
    return N.records(m.symbols, items(m))


@query("news_dedup", f"""SELECT ticker, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker, key ORDER BY {PRV}, doc_id) AS r FROM (
 SELECT *, lower(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) AS key FROM art) WHERE key<>'') WHERE r=1""")
def news_dedup(m):
    """First article per (ticker, title key)"""
    return N.dedup_titles(m.articles).select("ticker", "doc_id")


@query("news_weights", "SELECT doc_id, w AS weight FROM artw")
def news_weights(m):
    """Source weight times recency weight of every article"""
    return items(m).select("doc_id", "weight")


@query("news_sentiment", "SELECT ticker, score, n AS articles_found FROM sent0")
def news_sentiment(m):
    """Weighted mean score per ticker"""
    return N.sentiment(items(m))


@query("sentiment_record", "SELECT ticker, score, summary AS headline_summary, n AS articles_found, heads AS top_headlines FROM sent")
def sentiment_record(m):
    """Sentiment record of every symbol"""
    return records(m).withColumn("top_headlines", F.array_join("top_headlines", "|"))


@query("sentiment_fallback", """SELECT y.ticker, CASE WHEN s_suppkey%3=0 THEN CAST(s_suppkey%10 AS DOUBLE)/10 ELSE s.score END AS score, CASE WHEN s_suppkey%3=0 THEN 7 ELSE s.n END AS articles_found,
 CASE WHEN s_suppkey%3=0 THEN 'external' ELSE 'local' END AS origin FROM syms y JOIN sent s USING (ticker)""")
def sentiment_fallback(m):
    """External record where it answered, local record elsewhere"""
    ext = m.symbols.where(c("rank") % 3 == 0).select(c("symbol").alias("ticker"), ((c("rank") % 10) / 10).alias("score"),
                                                     F.lit(7).cast("bigint").alias("articles_found"))
    return N.with_fallback(m.symbols, ext, records(m).select("ticker", "score", "articles_found"))


@query("scorer_input", """SELECT ticker, md5(string_agg('- [' || source || '] ' || title || ': ' || substr(content,1,300), chr(10) ORDER BY prv, doc_id)) AS input_md5
 FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY prv, doc_id) AS r FROM artw) WHERE r<=12 GROUP BY ticker""")
def scorer_input(m):
    """Prompt text per ticker from its first twelve items"""
    return N.scorer_input(m.articles).select("ticker", F.md5("input").alias("input_md5"))


KINDS = ["earnings_beat", "regulatory", "partnership", "other"]


def answers(m):
    """One scored answer per document, in the shape a model would return."""
    k = c("doc_id")
    ev = lambda j: F.struct(
        F.when((k + j) % 5 != 0, F.concat(F.lit("Event "), k.cast("string"), F.lit(f"-{j}"))).alias("title"),
        F.when((k + j) % 4 != 3, lookup((k + j) % 4, dict(enumerate(KINDS)))).alias("event_type"), F.lit(None).cast("string").alias("description"),
        F.when((k + j) % 3 != 0, ((k + j) % 10) / 10).alias("magnitude"))
    doc = F.struct(F.lit(0.5).alias("sentiment_score"), F.array(ev(0), ev(1)).alias("key_events"))
    return m.articles.select("ticker", F.to_json(doc).alias("answer"))


fragment("evts", """SELECT ticker, 'Event ' || CAST(doc_id AS VARCHAR) || '-' || CAST(j AS VARCHAR) AS title, CASE (doc_id+j)%4 WHEN 0 THEN 'earnings_beat' WHEN 1 THEN 'regulatory' WHEN 2 THEN 'partnership' ELSE 'other' END AS event_type,
 CASE WHEN (doc_id+j)%3<>0 THEN CAST((doc_id+j)%10 AS DOUBLE)/10 ELSE 0.5 END AS magnitude FROM art, (SELECT unnest([0,1]) AS j) WHERE (doc_id+j)%5<>0""")


@query("event_parse", "SELECT ticker, title, event_type, magnitude FROM evts")
def event_parse(m):
    """Scored answers → titled events with defaults"""
    return N.scored_events(answers(m)).select("ticker", "title", "event_type", "magnitude")


def companies(m):
    return m.table("supplier").select(F.concat(F.lit("S"), c("s_suppkey").cast("string")).alias("ticker"),
                                      F.concat(F.lit("s"), c("s_suppkey").cast("string")).alias("company_id"), c("s_name").alias("name"))


@query("news_to_graph", """SELECT 'MENTIONED_IN' AS relation_type, ticker, count(*) AS edges, R4(sum(wt)) AS weight, R4(sum(conf)) AS confidence FROM (
 SELECT a.ticker, CASE source WHEN 'marketaux' THEN 1.0 WHEN 'newsapi' THEN 0.7 ELSE 0.5 END::DOUBLE AS wt, abs(s.score) AS conf, row_number() OVER (PARTITION BY a.ticker ORDER BY prv, doc_id) AS r FROM artw a JOIN sent0 s USING (ticker)) WHERE r<=8 AND CAST(substr(ticker,2) AS BIGINT)%2=0 GROUP BY ticker
 UNION ALL SELECT 'HAD_EVENT', ticker, count(*), CAST(count(*) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM evts WHERE CAST(substr(ticker,2) AS BIGINT)%2=0 GROUP BY ticker""")
def news_to_graph(m):
    """Edges from company nodes to their news items and events"""
    co = companies(m).where(F.substring("ticker", 2, 20).cast("bigint") % 2 == 0).select("ticker", "company_id")
    _, edges = N.to_graph(items(m), N.sentiment(items(m)), N.scored_events(answers(m)), co)
    return (edges.groupBy("relation_type", F.concat(F.lit("S"), F.substring("from_id", 2, 20)).alias("ticker"))
            .agg(F.count(F.lit(1)).alias("edges"), rnd(F.sum("weight"), 4).alias("weight"), rnd(F.sum("confidence"), 4).alias("confidence")))


# ── radar ───────────────────────────────────────────────────────────────────────────
def base_signals(m):
    """Simple-engine signals with the single best pattern of every symbol."""
    found = P.latest_patterns(m.kept_bars, best=True).select(c("symbol").alias("ticker"), "patterns")
    none = F.array().cast("array<struct<name:string,direction:string,explanation:string,strength:double,date:string,rank:int>>")
    return S.simple_signals(m.kept_bars).join(found, "ticker", "left").withColumn("patterns", F.coalesce("patterns", none))


def regime_records(m):
    """Regime-engine signals whose regimes see the whole history, so that breakouts can occur."""
    return S.regime_signals(m.kept_bars, history="full")


fragment("sigj", """SELECT s.symbol AS ticker, s.score, s.trend_state AS regime, s.act, R4(s.conf) AS conf, s.close, s.pct, s.n, coalesce(e.score,0) AS news, coalesce(e.summary,'') AS summary, e.heads, e.n AS found
FROM simple s LEFT JOIN sent e ON e.ticker=s.symbol""")
F2 = "printf('%.2f', R2({0}))"
SG = "CASE WHEN {0}>=0 THEN '+' ELSE '' END || printf('%.2f', R2({0}))"
fragment("al_conf", f"""SELECT ticker, 'TA_BSNM_CONFLUENCE' AS alert_type, ticker || ': Technical + News Confluence' AS title,
 'Strong TA buy signal (score ' || {F2.format('score')} || ', regime: ' || regime || ') confirmed by positive news sentiment (' || {SG.format('news')} || '). ' || summary AS body,
 least((conf+news)/2+0.1, 1) AS strength, 'bullish' AS direction, 'BUY' AS suggested_action FROM sigj WHERE act='BUY' AND news>0.25
UNION ALL SELECT ticker, 'TA_BSNM_BEAR_CONFLUENCE', ticker || ': Bearish Signal — Consider Exiting',
 'TA sell signal (score ' || {F2.format('score')} || ') combined with negative news (' || {SG.format('news')} || '). ' || summary, least((conf+abs(news))/2,1), 'bearish', 'SELL' FROM sigj WHERE act='SELL' AND news<-0.25""")
_EXPL = "CASE name " + " ".join("WHEN '%s' THEN '%s'" % (n, t.replace("'", "''")) for n, _, _, t in P.PATTERNS) + " END"
fragment("al_pat", f"""SELECT p.symbol AS ticker, 'CHART_PATTERN' AS alert_type, p.symbol || ': ' || name || ' Detected' AS title, replace({_EXPL}, '{{}}', coalesce(printf('%.1f', v.volume/v.vm), '')) AS body, strength*greatest(R4(s.conf),0.65) AS strength,
 direction, CASE direction WHEN 'bullish' THEN 'BUY' WHEN 'bearish' THEN 'SELL' ELSE 'WATCH' END AS suggested_action FROM p_best p JOIN simple s USING (symbol) LEFT JOIN (SELECT symbol, volume, vm FROM pvol WHERE vm>0) v USING (symbol) WHERE strength>=0.75""")
fragment("al_news", """SELECT e.ticker, 'STRONG_NEWS' AS alert_type, e.ticker || ': Strong ' || CASE WHEN e.score>0 THEN 'Positive' ELSE 'Negative' END || ' News Flow' AS title, e.summary AS body,
 least(abs(e.score),1)*0.7 AS strength, CASE WHEN e.score>0 THEN 'bullish' ELSE 'bearish' END AS direction, CASE WHEN s.act='HOLD' THEN 'WATCH' WHEN e.score>0 THEN 'BUY' ELSE 'SELL' END AS suggested_action
FROM sent e LEFT JOIN simple s ON s.symbol=e.ticker WHERE abs(e.score)>=0.5""")
_TRADE = {0: "bulk_buy", 1: "insider_sell", 2: "buy", 3: "block_deal"}


def trade_nodes(m):
    """Insider-trade nodes from orders: one per order of a company (supplier = customer modulo)."""
    k = c("o_orderkey")
    kind = lookup(k % 4, _TRADE)
    d = m.table("orders").select(
        F.concat(F.lit("t"), k.cast("string")).alias("id"), F.lit("InsiderTrade").alias("entity_type"), F.concat(F.lit("Trade "), k.cast("string")).alias("canonical_name"),
        F.lit(None).cast("string").alias("description"),
        F.create_map(F.lit("trade_type"), kind, F.lit("trader_name"), F.concat(F.lit("T"), (k % 9).cast("string")),
                     F.lit("value_crores"), rnd(c("o_totalprice") / 1e4, 2).cast("string"), F.lit("quantity"), F.when(k % 3 != 0, (k % 1000).cast("string")),
                     F.lit("price"), F.lit("12.5")).alias("attributes"),
        F.concat(F.lit("s"), (c("o_custkey") % m.symbol_count).cast("string")).alias("from_id"))
    return d.select("id", "entity_type", "canonical_name", "description", "attributes"), d.select("from_id", c("id").alias("to_id"))


_KIND = "CASE o_orderkey%4 WHEN 0 THEN 'bulk_buy' WHEN 1 THEN 'insider_sell' WHEN 2 THEN 'buy' ELSE 'block_deal' END"
fragment("al_ins", f"""SELECT ticker, 'INSIDER_TRADE' AS alert_type, ticker || ': Significant ' || CASE kind WHEN 'bulk_buy' THEN 'Bulk Buy' WHEN 'insider_sell' THEN 'Insider Sell' WHEN 'buy' THEN 'Buy' ELSE 'Block Deal' END AS title,
 CASE WHEN o_orderkey%3<>0 THEN 'T' || CAST(o_orderkey%9 AS VARCHAR) || CASE WHEN buy THEN ' bought ' ELSE ' sold ' END || '₹' || printf('%.1f', R1(v)) || ' Cr worth of ' || ticker || ' (' || CAST(o_orderkey%1000 AS VARCHAR) || ' shares @ ₹12.50)'
  ELSE 'T' || CAST(o_orderkey%9 AS VARCHAR) || ' executed a significant ' || replace(kind,'_',' ') || '.' END AS body,
 least(v/100, 0.9) AS strength, CASE WHEN buy THEN 'bullish' ELSE 'bearish' END AS direction, 'WATCH' AS suggested_action
FROM (SELECT *, {_KIND} AS kind, o_orderkey%4 IN (0,2) AS buy, R2(o_totalprice/1e4) AS v, 'S' || CAST(o_custkey % (SELECT n FROM nsup) AS VARCHAR) AS ticker FROM orders) WHERE v>=10""")
fragment("al_evt", """SELECT ticker, 'CORPORATE_EVENT' AS alert_type, ticker || ': ' || title AS title, title AS body, magnitude*0.8 AS strength,
 CASE WHEN event_type IN ('earnings_beat','partnership') THEN 'bullish' WHEN event_type='regulatory' THEN 'bearish' ELSE 'neutral' END AS direction, 'WATCH' AS suggested_action FROM evts WHERE magnitude>=0.6""")
fragment("al_reg", """SELECT symbol AS ticker, 'REGIME_ALERT' AS alert_type, symbol || ': ' || regime || ' Regime Detected' AS title, CASE regime WHEN 'WHALE' THEN 'Institutional activity — volume spike + wide-range bar' ELSE 'Breakout — ATR expanding, price at 60-day high/low' END AS body, CASE WHEN regime='WHALE' THEN 0.7 ELSE 0.65 END::DOUBLE AS strength,
 CASE WHEN score>0 THEN 'bullish' ELSE 'bearish' END AS direction, 'WATCH' AS suggested_action FROM regsig_full WHERE n>=200 AND regime IN ('WHALE','BREAKOUT')""")
_ALL = " UNION ALL ".join(f"SELECT ticker, alert_type, title, body, CAST(strength AS DOUBLE) AS strength, direction, suggested_action FROM {x}" for x in ("al_conf", "al_pat", "al_reg", "al_news", "al_ins", "al_evt"))
fragment("al_all", _ALL)
fragment("radar", "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY ticker, title ORDER BY strength DESC, alert_type, body) AS r FROM al_all) WHERE r=1")
AL = "ticker, alert_type, title, body, R4(strength) AS strength, direction, suggested_action"


def shown(d):
    return d.select("ticker", "alert_type", "title", "body", rnd(c("strength"), 4).alias("strength"), "direction", "suggested_action")


def signal_news(m):
    return R.joined(base_signals(m), records(m))


def insider(m):
    nodes, edges = trade_nodes(m)
    return R.insider_alerts(R.linked(edges, nodes, companies(m), "InsiderTrade"))


def event_nodes(m):
    ev = N.scored_events(answers(m))
    co = companies(m).select("ticker", "company_id")
    return ev.join(co, "ticker").select("ticker", c("title").alias("canonical_name"), "description", F.create_map(
        F.lit("event_type"), c("event_type"), F.lit("magnitude"), c("magnitude").cast("string")).alias("attributes"))


def streams(m):
    """Every alert stream of the radar; regimes come from the regime engine."""
    return R.union(R.signal_alerts(m.once("base_signals", base_signals), m.once("records", records)),
                   R.regime_alerts(regime_records(m)), insider(m), R.event_alerts(event_nodes(m)))


def all_alerts(m):
    return R.distinct_alerts(streams(m))


@query("radar_candidates", "SELECT symbol AS ticker, score FROM simple ORDER BY abs(score) DESC, symbol LIMIT 30")
def radar_candidates(m):
    """Thirty symbols with the largest absolute score"""
    return R.candidates(S.simple_signals(m.bars)).select("ticker", "score")


@query("join_signal_sentiment", "SELECT ticker, score, news, summary AS headline_summary FROM sigj")
def join_signal_sentiment(m):
    """Signals with their news sentiment"""
    return R.joined(S.simple_signals(m.bars), records(m)).select("ticker", "score", "news", "headline_summary")


@query("alert_confluence", f"SELECT {AL} FROM al_conf")
def alert_confluence(m):
    """Signal and news agree"""
    return shown(R.confluence(signal_news(m)))


@query("alert_pattern", f"SELECT {AL} FROM al_pat")
def alert_pattern(m):
    """Strong chart patterns"""
    return shown(R.pattern_alerts(base_signals(m)))


@query("alert_regime", f"SELECT {AL} FROM al_reg")
def alert_regime(m):
    """Breakout and institutional-activity regimes"""
    return shown(R.regime_alerts(regime_records(m)))


@query("alert_news", f"SELECT {AL} FROM al_news")
def alert_news(m):
    """Strong stand-alone news flow"""
    return shown(R.news_alerts(records(m), S.simple_signals(m.bars)))


@query("alert_insider", f"SELECT {AL} FROM al_ins")
def alert_insider(m):
    """Significant insider trades"""
    return shown(insider(m))


@query("alert_event", f"SELECT {AL} FROM al_evt")
def alert_event(m):
    """High-magnitude corporate events"""
    return shown(R.event_alerts(event_nodes(m)))


@query("radar_scan", f"SELECT {AL} FROM radar")
def radar_scan(m):
    """All alerts, the strongest per (ticker, title)"""
    return shown(all_alerts(m))


@query("radar_cards", """SELECT ticker, category, arg_min(title, row(-strength, title)) AS title, arg_min(body, row(-strength, title)) AS body, R4(max(strength)) AS strength, count(*) AS alert_count,
 CASE WHEN count(*)>1 THEN md5(string_agg(DISTINCT title, '|' ORDER BY title)) END AS titles FROM (SELECT *, CASE WHEN alert_type IN ('TA_BSNM_CONFLUENCE','TA_BSNM_BEAR_CONFLUENCE','CHART_PATTERN','REGIME_ALERT') THEN 'technical' ELSE 'news_market' END AS category FROM radar)
 GROUP BY 1,2""")
def radar_cards(m):
    """One card per (ticker, category)"""
    d = R.cards(all_alerts(m))
    return d.select("ticker", "category", "title", "body", rnd(c("strength"), 4).alias("strength"), "alert_count",
                    F.when(c("alert_count") > 1, F.md5(F.array_join("evidence", "|"))).alias("titles"))


@query("alerts_topk", "SELECT ticker, title, R4(strength) AS strength, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY strength DESC, title) AS r FROM radar) WHERE r<=8")
def alerts_topk(m):
    """Eight strongest alerts per ticker"""
    d = all_alerts(m)
    from pyspark.sql import Window
    w = Window.partitionBy("ticker").orderBy(c("strength").desc(), "title")
    return d.withColumn("rank", F.row_number().over(w)).where(c("rank") <= 8).select("ticker", "title", rnd(c("strength"), 4).alias("strength"), c("rank").cast("bigint").alias("rank"))


@query("union_alerts", "SELECT alert_type, count(*) AS alerts FROM al_all GROUP BY 1")
def union_alerts(m):
    """Union of all alert streams"""
    return streams(m).groupBy("alert_type").agg(F.count(F.lit(1)).alias("alerts"))


fragment("hold", "SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, l_suppkey AS pos, sum(l_quantity) AS quantity, sum(l_extendedprice)/sum(l_quantity) AS avg_cost FROM lineitem WHERE l_suppkey%5=0 GROUP BY l_suppkey")
fragment("who", """SELECT symbol, min(list*1000000000+pos) AS o FROM (SELECT symbol, 0 AS list, pos FROM hold UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 1, s_suppkey FROM supplier WHERE s_suppkey%2=0) GROUP BY symbol""")


def watchlist(m):
    return m.symbols.where("in_watchlist").select("symbol", c("rank").alias("pos"))


@query("union_distinct_ordered", "SELECT symbol, o//1000000000 AS list, o%1000000000 AS pos FROM who")
def union_distinct_ordered(m):
    """Holdings then watchlist, first occurrence kept"""
    return R.ordered_union(m.holdings, watchlist(m)).select("symbol", c("list").cast("bigint").alias("list"), "pos")


@query("portfolio_view", """SELECT w.symbol, s.act AS suggested_action, s.score, R2(h.quantity) AS quantity, R2(h.avg_cost) AS avg_cost, coalesce(a.alerts,'') AS alerts FROM (SELECT * FROM who ORDER BY o LIMIT 20) w
 LEFT JOIN simple s USING (symbol) LEFT JOIN hold h USING (symbol) LEFT JOIN (SELECT ticker AS symbol, string_agg(DISTINCT title, '|' ORDER BY title) AS alerts FROM radar GROUP BY 1) a USING (symbol)""")
def portfolio_view(m):
    """Portfolio rows with signals and alerts"""
    d = R.portfolio(m.holdings, watchlist(m), m.once("base_signals", base_signals), all_alerts(m))
    return d.select("symbol", "suggested_action", "score", rnd(c("quantity"), 2).alias("quantity"), rnd(c("avg_cost"), 2).alias("avg_cost"),
                    nz(F.array_join("alerts", "|"), "").alias("alerts"))


@query("intel_view", """SELECT s.symbol AS ticker, s.act AS suggested_action, x.s_name AS company, coalesce(a.alerts,'') AS alerts, 's' || substr(s.symbol,2) AS entities FROM simple s JOIN supplier x ON 'S' || CAST(x.s_suppkey AS VARCHAR)=s.symbol
 LEFT JOIN (SELECT ticker, string_agg(title, '|' ORDER BY title) AS alerts FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY strength DESC, title) AS r FROM radar) WHERE r<=8 GROUP BY 1) a ON a.ticker=s.symbol""")
def intel_view(m):
    """Signal, alerts, graph hits and company of every ticker in one row"""
    d = R.intel(m.once("base_signals", base_signals), all_alerts(m), m.nodes, companies(m))
    return d.select("ticker", "suggested_action", c("name").alias("company"), nz(F.array_join("alerts", "|"), "").alias("alerts"),
                    F.array_join("entities", "|").alias("entities"))


MOV = "SELECT symbol AS ticker, R2((close-pc)/pc*100) AS pct_change FROM pb WHERE i=n-1 AND pc>0"


@query("movers", f"""WITH g AS (SELECT *, 'gainer' AS role FROM ({MOV}) ORDER BY pct_change DESC, ticker LIMIT 3), l AS (SELECT *, 'loser' AS role FROM ({MOV}) ORDER BY pct_change, ticker DESC LIMIT 3)
 SELECT * FROM g UNION ALL SELECT * FROM l WHERE ticker NOT IN (SELECT ticker FROM g)""")
def movers(m):
    """Three gainers and three losers"""
    return R.movers(pct_moves(m).select("ticker", "pct_change"))


@query("topk_both_ends", f"""SELECT ticker, pct_change, role FROM (SELECT *, CASE WHEN up<=10 THEN 'gainer' WHEN dn<=10 THEN 'loser' END AS role FROM (SELECT *, row_number() OVER (ORDER BY pct_change DESC, ticker) AS up, row_number() OVER (ORDER BY pct_change, ticker DESC) AS dn FROM ({MOV}))) WHERE role IS NOT NULL""")
def topk_both_ends(m):
    """Ten symbols from each end of one ranking"""
    return R.movers(pct_moves(m).select("ticker", "pct_change"), 10)


@query("insights_fill", """SELECT s.symbol AS ticker, 'doc ' || CAST(d.doc_id AS VARCHAR) AS summary, s.pct AS pct_change, CASE WHEN d.doc_id%2=0 THEN 1.0::DOUBLE ELSE s.close END AS last_close, s.score, CASE WHEN d.doc_id%3=0 THEN 'SELL' ELSE s.act END AS action
 FROM (SELECT doc_id % (SELECT n FROM nsup) AS k, min(doc_id) AS doc_id FROM documents GROUP BY 1) d JOIN simple s ON s.symbol='S' || CAST(d.k AS VARCHAR)""")
def insights_fill(m):
    """First insight per ticker with numbers filled in"""
    k, none = c("doc_id"), F.lit(None).cast("double")
    d = m.articles.select(F.lower("ticker").alias("ticker"), k.alias("pos"), F.concat(F.lit("doc "), k.cast("string")).alias("summary"), none.alias("pct_change"),
                          F.when(k % 2 == 0, 1.0).alias("last_close"), none.alias("score"), F.when(k % 3 == 0, "SELL").alias("action"))
    return R.fill_insights(d, S.simple_signals(m.bars))


@query("market_overview", """SELECT * FROM (SELECT 'signal' AS section, symbol AS ticker, signal AS label, conviction AS value FROM conv ORDER BY conviction DESC, symbol LIMIT 5)
 UNION ALL SELECT * FROM (SELECT 'alert', ticker, title, R4(strength) FROM radar ORDER BY strength DESC, ticker, title LIMIT 3)""")
def market_overview(m):
    """Top signals and top alerts"""
    d = R.overview(S.with_conviction(m.once("base_signals", base_signals)), all_alerts(m))
    return d.withColumn("value", rnd(c("value"), 4))


@query("topk_conviction", "SELECT symbol AS ticker, conviction FROM conv ORDER BY conviction DESC, symbol LIMIT 30")
def topk_conviction(m):
    """Thirty symbols by conviction"""
    return S.top_conviction(S.simple_signals(m.bars), 30).select("ticker", "conviction")


@query("ticker_context", f"""SELECT q.id, q.symbol, s.symbol || ': ' || s.act || ' score ' || {F2.format('s.score')} || ' regime ' || s.trend_state AS line, coalesce(a.alerts,'') AS alerts
 FROM (SELECT conv_id*1000+turn AS id, unnest(['S' || CAST(conv_id%10 AS VARCHAR), 'S5']) AS symbol, unnest([0,1]) AS j, conv_id FROM conversations) q JOIN simple s ON s.symbol=q.symbol
 LEFT JOIN (SELECT ticker, string_agg(title || ': ' || substr(body,1,120), '; ' ORDER BY title || ': ' || substr(body,1,120)) AS alerts FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY strength DESC, title) AS r FROM radar) WHERE r<=2 GROUP BY 1) a ON a.ticker=q.symbol
 WHERE NOT (q.j=1 AND q.conv_id%10=5)""")
def ticker_context(m):
    """Signal line and alerts for every symbol named in a message"""
    text = e("'buy S' || CAST(conv_id%10 AS STRING) || ' and S5'")
    msgs = m.table("conversations").select((c("conv_id") * 1000 + c("turn")).alias("id"), text.alias("text"))
    named = X.mentions(msgs, m.symbols, "id", "text").select("id", "symbol")
    return R.ticker_context(named, m.once("base_signals", base_signals), all_alerts(m))


@query("veto_gate", """SELECT symbol AS ticker, CASE WHEN act='BUY' THEN CASE WHEN b<=-0.4 THEN 'Hold' ELSE 'Buy' END WHEN act='HOLD' THEN CASE WHEN b>=0.35 THEN 'Buy' ELSE 'Hold' END ELSE 'Sell' END AS final_action,
 NOT (act='BUY' AND b<=-0.4) AS allow_buy, CASE WHEN act='BUY' AND b<=-0.4 THEN 'Hard Business Veto (b=' || printf('%.3f', R3(b)) || ')' WHEN act='HOLD' AND b>=0.35 THEN 'Business Positive Upgrade (b=' || printf('%.3f', R3(b)) || ')' END AS reason,
 R4(score+so*0.15) AS ta_score_boosted, b AS business, so AS social, R4(abs(score/1.5)) AS confidence
 FROM (SELECT s.symbol, s.act, s.score, coalesce(e.score,0) AS b, coalesce(q.m,0) AS so FROM simple s LEFT JOIN sent0 e ON e.ticker=s.symbol LEFT JOIN (SELECT ticker, R4(avg(raw)) AS m FROM artw GROUP BY 1) q ON q.ticker=s.symbol)""")
def veto_gate(m):
    """Sentiment gate over the signal set"""
    it = items(m)
    business = N.sentiment(it).select("ticker", c("score").alias("sentiment"))
    social = it.groupBy("ticker").agg(rnd(F.avg("raw_score"), 4).alias("sentiment"))
    sig = S.simple_signals(m.bars).withColumn("ticker", F.concat("ticker", F.lit(".NS")))
    d = S.veto(sig, business, social)
    return d.select(S.bare_symbol(c("ticker")).alias("ticker"), "final_action", "allow_buy", "reason", rnd(c("ta_score_boosted"), 4).alias("ta_score_boosted"),
                    "business", "social", rnd(c("confidence"), 4).alias("confidence"))


@query("topk_per_group", "SELECT ticker, doc_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY prv, doc_id) AS r FROM artw) WHERE r<=8")
def topk_per_group(m):
    """First eight articles per ticker"""
    from pyspark.sql import Window
    w = Window.partitionBy("ticker").orderBy(*N.feed_order())
    return m.articles.withColumn("rank", F.row_number().over(w).cast("bigint")).where(c("rank") <= 8).select("ticker", "doc_id", "rank")
