"""Streaming, standing-condition and catalog queries."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.numeric import day, lookup, nz, rnd
from ..operators import indicators as I, signals as S, watches as W
from ..session import shared_folder
from ..sources import store as B
from ..streaming import ordered as O, streams as Z, watching
from . import functions_catalog as C
from .oracle import fragment, recursions
from .registry import query

c = F.col
HOUR = "yyyy-MM-dd HH"


@query("stream_bars", """SELECT symbol, strftime(ts,'%Y-%m-%d %H') AS ts, open, high, low, close, volume FROM hbars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_bars(m):
    """Hourly bars built from the tick stream"""
    schema = m.table("events").schema
    ticks = Z.follow(m.spark, m.folder, schema, only="events.parquet").select(
        c("event_type").alias("symbol"), c("ts").cast("timestamp").alias("ts"), c("value").alias("price"), F.lit(1.0).alias("qty"), c("event_id").alias("seq"))
    return Z.run_available(Z.bars(ticks)).withColumn("ts", F.date_format("ts", HOUR))


fragment("hpb", """SELECT symbol, ts, open, high, low, close, volume, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM hbars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
recursions("hpb", "hind")


def bar_feed(m):
    """Hourly bars landed in three time slices and followed as a stream."""
    b = m.hourly_bars
    t = lambda s: F.lit(s).cast("timestamp")
    path = Z.land(b, [c("ts") < t("2024-01-10"), (c("ts") >= t("2024-01-10")) & (c("ts") < t("2024-01-20")), c("ts") >= t("2024-01-20")])
    return Z.follow(m.spark, path, b.schema)


def late_feed(m):
    """The same bars, every seventh one a slice late, and a closing row."""
    b = m.hourly_bars
    t = lambda s: F.lit(s).cast("timestamp")
    late = (F.hour("ts") % 7 == 3) & (c("ts") < t("2024-01-20"))
    path = Z.land(b, [(c("ts") < t("2024-01-10")) & ~late, (c("ts") >= t("2024-01-10")) & (c("ts") < t("2024-01-20")) & ~late | (late & (c("ts") < t("2024-01-10"))),
                      (c("ts") >= t("2024-01-20")) | (late & (c("ts") >= t("2024-01-10")))])
    O.closing(m.spark, b.schema).write.mode("append").parquet(path)
    return Z.follow(m.spark, path, b.schema)


@query("stream_indicators", "SELECT p.symbol, strftime(p.ts,'%Y-%m-%d %H') AS ts, R4(d.e20) AS ema20, R4(d.hist) AS macd_hist, R4(d.atr14) AS atr14, R4(d.adx) AS adx, R4(d.rsi) AS rsi, d.st_seeded AS supertrend_seeded FROM hind d JOIN hpb p USING (symbol, i)")
def stream_indicators(m):
    """Indicators advanced bar by bar in event-time order, some bars late"""
    w = ["ema20", "macd_hist", "atr14", "adx", "rsi", "supertrend_seeded"]
    d = Z.run_available(O.in_order(late_feed(m), O.Recursion(w), "21 days")).where("NOT late")
    return d.select("symbol", F.date_format("ts", HOUR).alias("ts"), *[rnd(c(x), 4).alias(x) if x != "supertrend_seeded" else c(x) for x in w])


fragment("hslc", """SELECT symbol || '#' || CAST(blk AS VARCHAR) AS symbol, ts, high, low, close, volume, i - (172+blk*28) AS i, pc, ph, pl FROM (
 SELECT *, CAST(floor((i-172)/28.0) AS BIGINT) AS blk FROM hpb WHERE i>=172) WHERE 172+(blk+1)*28<=n""")
recursions("hslc", "khslc")


def _hreg():
    from .signal_queries import _regime_sql
    fragment("reg_h", _regime_sql("hslc", "khslc"))


_hreg()


@query("stream_regime", "SELECT split_part(symbol,'#',1) AS symbol, 199 + CAST(split_part(symbol,'#',2) AS BIGINT)*28 AS from_bar, regime FROM reg_h")
def stream_regime(m):
    """Regime at every refresh point, from keyed state over the bars in event-time order, some bars late"""
    d = Z.run_available(O.in_order(late_feed(m), O.RefreshPoints(), "21 days")).where("NOT late")
    d = d.select("symbol", "from_bar", F.timestamp_seconds(c("j") * 3600).alias("ts"), c("close").alias("open"), "high", "low", "close", "volume")
    keys = ["symbol", "from_bar"]
    return S.regimes(I.clustered(d, keys), keys)


@query("stream_dedup", "SELECT DISTINCT url FROM art")
def stream_dedup(m):
    """First article per url over the stream"""
    docs = m.table("documents").schema
    raw = Z.follow(m.spark, m.folder, docs, only="documents.parquet")
    items = raw.select(F.concat(F.lit("https://news.example/"), (c("doc_id") % 700).cast("string")).alias("url"),
                       F.expr("CAST(date_add(DATE '2024-01-01', CAST(doc_id % 30 AS INT)) AS TIMESTAMP)").alias("at"))
    return Z.run_available(Z.dedup(items, "url", "at", "60 days")).select("url")


# ── standing conditions ─────────────────────────────────────────────────────────────
def watches(m):
    """Four watches per symbol, one of each metric plus an unknown one."""
    k = c("rank")
    kind = F.explode(F.array(*[F.lit(j) for j in range(4)]))
    d = m.symbols.select(c("symbol").alias("ticker"), k, kind.alias("j"))
    metric = lookup(c("j"), {0: "price", 1: "pct_change", 2: "action"}, "volume")
    op = F.when(c("j") == 2, "==").otherwise(lookup(k % 5, {0: ">", 1: "<", 2: ">=", 3: "<="}, "!="))
    num = F.when(c("j") == 0, 500.0 + k % 50 * 100).when(c("j") == 1, 5.0)
    d = d.select(F.concat("ticker", F.lit("-"), c("j").cast("string")).alias("id"), "ticker", metric.alias("metric"), op.alias("operator"),
                 num.cast("double").alias("threshold_num"), F.when(c("j") == 2, F.when(k % 2 == 0, "buy").otherwise("sell")).alias("threshold_str"),
                 F.lit("").alias("description"), (k % 11 != 0).alias("active"), F.lit(None).cast("timestamp").alias("fired_at"))
    return W.described(d)


fragment("wat", """SELECT ticker || '-' || CAST(j AS VARCHAR) AS id, ticker, k, j, CASE WHEN j=2 THEN '==' ELSE CASE k%5 WHEN 0 THEN '>' WHEN 1 THEN '<' WHEN 2 THEN '>=' WHEN 3 THEN '<=' ELSE '!=' END END AS op,
 CASE j WHEN 0 THEN 500.0 + (k%50)*100 WHEN 1 THEN 5.0 END::DOUBLE AS num, CASE WHEN k%2=0 THEN 'BUY' ELSE 'SELL' END AS act, k%11<>0 AS active FROM (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS ticker, s_suppkey AS k, unnest([0,1,2,3]) AS j FROM supplier)""")
fragment("fired", """SELECT w.id, min(s.ts) AS ts FROM wat w JOIN simple s ON s.symbol=w.ticker WHERE active AND CASE w.j WHEN 2 THEN s.act=w.act WHEN 3 THEN false ELSE
 CASE w.op WHEN '>' THEN v0>num WHEN '<' THEN v0<num WHEN '>=' THEN v0>=num WHEN '<=' THEN v0<=num ELSE false END END GROUP BY w.id""".replace("v0", "(CASE w.j WHEN 0 THEN s.close ELSE s.pct END)"))


def readings(m):
    return S.simple_signals(m.bars).select("ticker", "ts", c("last_close").alias("price"), "pct_change", "score", c("suggested_action").alias("action"))


@query("watch_fire", "SELECT id, strftime(ts,'%Y-%m-%d') AS fired_at FROM fired")
def watch_fire(m):
    """Watches that fire on the newest signals"""
    d = W.fire(readings(m), watches(m))
    return d.select("id", day(c("fired_at")).alias("fired_at"))


@query("watch_table", "SELECT w.id, w.active AND f.ts IS NULL AS active, f.ts IS NOT NULL AS fired FROM wat w LEFT JOIN fired f USING (id)")
def watch_table(m):
    """Watch table after a run"""
    w = watches(m)
    return W.settle(w, W.fire(readings(m), w)).select("id", "active", c("fired_at").isNotNull().alias("fired"))


@query("watch_lifecycle", """SELECT ticker || '-new' AS id, ticker, ticker || ' price > 100.0' AS description, 'waiting' AS state FROM wat WHERE j=0
 UNION ALL SELECT w.id, w.ticker, w.ticker || ' ' || CASE j WHEN 0 THEN 'price' WHEN 1 THEN 'pct_change' WHEN 2 THEN 'action' ELSE 'volume' END || ' ' || op || CASE WHEN j=2 THEN ' ' || lower(act) WHEN num IS NULL THEN '' ELSE ' ' || CAST(num AS VARCHAR) END,
 CASE WHEN f.ts IS NOT NULL THEN 'fired' WHEN active THEN 'waiting' ELSE 'paused' END FROM wat w LEFT JOIN fired f USING (id) WHERE k%7<>0""")
def watch_lifecycle(m):
    """Watches after a run, some deleted, one created for every symbol"""
    w = watches(m)
    w = W.delete(W.settle(w, W.fire(readings(m), w)), w.join(m.symbols.where(c("rank") % 7 == 0).select(c("symbol").alias("ticker")), "ticker", "left_semi"))
    none = F.lit(None)
    new = m.symbols.select(F.concat("symbol", F.lit("-new")).alias("id"), c("symbol").alias("ticker"), c("rank"), F.lit(0).alias("j"), F.lit("price").alias("metric"), F.lit(">").alias("operator"),
                           F.lit(100.0).alias("threshold_num"), none.cast("string").alias("threshold_str"), none.cast("string").alias("description"))
    return W.listing(W.create(w, new.select(*[x for x in w.columns if x in new.columns]))).drop("fired_at")


@query("stream_watch", """SELECT t || '-' || op AS id, t AS ticker, 'close' AS description, arg_min(close, ts) AS current_value, strftime(min(ts),'%Y-%m-%d %H') AS ts FROM hbars b JOIN (SELECT DISTINCT event_type AS t, o AS op, x AS lim FROM events, (SELECT unnest(['>','<']) AS o, unnest([60.0,5.0]) AS x)) w ON w.t=b.symbol
 WHERE (op='>' AND close>lim) OR (op='<' AND close<lim) GROUP BY 1, 2""")
def stream_watch(m):
    """Fire-once conditions over the bar stream"""
    feed = bar_feed(m).select(c("symbol").alias("ticker"), "ts", c("close").alias("price"), F.lit(None).cast("double").alias("pct_change"),
                              F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("action"))
    op = F.explode(F.array(F.lit(">"), F.lit("<")))
    w = m.ticks.select("symbol").distinct().select(c("symbol").alias("ticker"), op.alias("operator"))
    w = w.select(F.concat("ticker", F.lit("-"), "operator").alias("id"), "ticker", F.lit("price").alias("metric"), "operator",
                 F.when(c("operator") == ">", 60.0).otherwise(5.0).alias("threshold_num"), F.lit(None).cast("string").alias("threshold_str"),
                 F.lit("close").alias("description"), F.lit(True).alias("active"))
    return Z.run_available(Z.fire_once(feed, w)).select("id", "ticker", "description", "current_value", F.date_format("ts", HOUR).alias("ts"))


@query("stream_watch_control", """WITH w AS (SELECT DISTINCT event_type AS ticker, k AS kind, CASE k WHEN 'up' THEN TIMESTAMP '2024-01-05' WHEN 'down' THEN TIMESTAMP '2024-01-05' ELSE TIMESTAMP '2024-01-25' END AS since,
  CASE k WHEN 'down' THEN TIMESTAMP '2024-01-15' ELSE TIMESTAMP '2100-01-01' END AS until FROM events, (SELECT unnest(['up','down','new']) AS k))
 SELECT ticker || '-' || kind AS id, ticker, kind AS description, arg_min(close, ts) AS current_value, strftime(min(ts),'%Y-%m-%d %H') AS ts FROM hbars b JOIN w ON w.ticker=b.symbol
 WHERE ts>=since AND ts<until AND CASE kind WHEN 'up' THEN close>60 WHEN 'down' THEN close<5 ELSE close>=50 END GROUP BY kind, ticker""")
def stream_watch_control(m):
    """Fired-event feed of watches that are created and deleted while the bars arrive"""
    t = lambda s: F.lit(s).cast("timestamp")
    make = lambda kind, at, op, x, command="create": F.struct(
        F.lit(kind).alias("kind"), t(at).alias("ts"), F.lit(command).alias("command"), F.lit(op).alias("operator"), F.lit(x).alias("threshold_num"))
    rows = F.array(make("up", "2024-01-05", ">", 60.0), make("down", "2024-01-05", "<", 5.0), make("down", "2024-01-15", "<", 5.0, "delete"), make("new", "2024-01-25", ">=", 50.0))
    controls = m.ticks.select("symbol").distinct().select(c("symbol").alias("ticker"), F.explode(rows).alias("r")).select(
        "ticker", "r.ts", F.concat("ticker", F.lit("-"), "r.kind").alias("id"), "r.command", F.lit("price").alias("metric"), "r.operator", "r.threshold_num",
        F.lit(None).cast("string").alias("threshold_str"), c("r.kind").alias("description"))
    feed = m.hourly_bars.select(c("symbol").alias("ticker"), "ts", c("close").alias("price"), *[F.lit(None).cast(watching.READING[n]).alias(n) for n in ("pct_change", "score", "action")])
    both = watching.events(controls, feed)
    told, first, second = c("command").isNotNull(), c("ts") < t("2024-01-10"), c("ts") < t("2024-01-20")
    # each slice's control rows arrive before its readings
    parts = [x & y for x in (first, ~first & second, ~second) for y in (told, ~told)]
    stream = Z.follow(m.spark, Z.land(both, parts), both.schema)
    base = f"{shared_folder(m.spark)}/watch-{uuid.uuid4().hex}"
    fired = watching.follow_into(watching.fired(stream.where(told), stream.where(~told)), f"{base}/fired", f"{base}/checkpoint")
    return fired.select("id", "ticker", "description", "current_value", F.date_format("ts", HOUR).alias("ts"))


@query("cache_miss_split", """SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS symbol, coalesce(h.hit, false) AS hit FROM supplier LEFT JOIN (SELECT DISTINCT user_id%(SELECT n FROM nsup) AS k, true AS hit FROM events WHERE epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(ts)) BETWEEN 0 AND 86399) h ON h.k=s_suppkey""")
def cache_miss_split(m):
    """Cache hits and misses of the requested symbols"""
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    cached = m.table("events").select(F.concat(F.lit("S"), (c("user_id") % m.symbol_count).cast("string")).alias("symbol"), c("ts").cast("timestamp").alias("computed_at"))
    return W.cache_split(m.symbols.select("symbol"), cached.where(F.unix_timestamp("computed_at") <= F.unix_timestamp(now)), now, 86400)


@query("run_status", """SELECT event_type AS job, count(*) AS runs, arg_max(CASE WHEN event_id%7=0 THEN 'error' ELSE 'ok' END, ts) AS status, arg_max(value, ts) AS elapsed FROM events GROUP BY 1""")
def run_status(m):
    """Last state of every job from the run log"""
    bad = c("event_id") % 7 == 0
    log = m.table("events").select(c("event_type").alias("job"), c("event_id").alias("run_id"), F.when(bad, "error").otherwise("ok").alias("status"),
                                   c("ts").alias("started_at"), c("value").alias("elapsed"), F.when(bad, "failed").alias("error"))
    return W.run_status(log).select("job", "runs", "status", "elapsed")


# ── functions ───────────────────────────────────────────────────────────────────────
@query("catalog", "SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm_name, s_name || '.NS' AS feed_symbol FROM supplier")
def catalog(m):
    """Registered SQL functions over the supplier table"""
    C.install(m.spark)
    return m.table("supplier").select("s_suppkey", F.expr("normalize_name(s_name)").alias("norm_name"), F.expr("feed_symbol(s_name)").alias("feed_symbol"))


def function_views(m):
    """Builders of the views that the table functions read."""
    from .news_queries import N, all_alerts, items
    return {"nodes": lambda: m.nodes, "edges": lambda: m.edges, "signals": lambda: S.simple_signals(m.bars), "sentiment": lambda: N.sentiment(items(m)),
            "alerts": lambda: all_alerts(m), "macro": lambda: B.latest_and_previous(m.bars), "holdings": lambda: m.holdings}


@query("function_calls", """SELECT 'company_info' AS name, upper(id) AS argument, name AS result, 1::BIGINT AS total FROM gnodes WHERE entity_type='Supplier'
 UNION ALL SELECT 'technical_signals', symbol, act, 1 FROM simple UNION ALL SELECT 'news_sentiment', q.ticker, CAST(q.n AS VARCHAR), 1 FROM sent0 q JOIN supplier ON q.ticker='S' || CAST(s_suppkey AS VARCHAR)
 UNION ALL SELECT 'explore_connections', id, relation_type || ' ' || direction, count(*) FROM (SELECT from_id AS id, relation_type, 'out' AS direction FROM gedges UNION ALL SELECT to_id, relation_type, 'in' FROM gedges) GROUP BY ALL
 UNION ALL SELECT 'graph_overview', entity_type, 'nodes', count(*) FROM gnodes GROUP BY 2 UNION ALL SELECT 'macro_latest', symbol, CASE WHEN close>pc THEN 'up' ELSE 'down' END, 1 FROM pb WHERE i=n-1
 UNION ALL SELECT 'holding', 'S' || CAST(l_suppkey AS VARCHAR), CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR), 1 FROM lineitem WHERE l_suppkey%5=0 GROUP BY l_suppkey
 UNION ALL (SELECT 'search_nodes', id, name, 1 FROM gnodes WHERE contains(lower(name),'ring') ORDER BY id LIMIT 20)""", bounded=True)
def function_calls(m):
    """Every table function that needs no alerts, called for all its arguments"""
    C.install_tables(m.spark, function_views(m), [f.name for f in C.TABLE_FUNCTIONS if f.name != "radar_alerts"])
    m.symbols.createOrReplaceTempView("symbols_view")
    return m.spark.sql("""SELECT 'company_info' AS name, s.symbol AS argument, f.canonical_name AS result, 1L AS total FROM symbols_view s, LATERAL company_info(s.symbol) f
 UNION ALL SELECT 'technical_signals', s.symbol, f.suggested_action, 1L FROM symbols_view s, LATERAL technical_signals(s.symbol) f
 UNION ALL SELECT 'news_sentiment', s.symbol, string(f.articles_found), 1L FROM symbols_view s, LATERAL news_sentiment(s.symbol) f
 UNION ALL SELECT 'explore_connections', n.id, concat(f.relation_type, ' ', f.direction), count(*) FROM nodes_view n, LATERAL explore_connections(n.id) f GROUP BY ALL
 UNION ALL SELECT 'graph_overview', entity_type, 'nodes', total FROM graph_overview()
 UNION ALL SELECT 'macro_latest', s.symbol, CASE WHEN f.pct_change > 0 THEN 'up' ELSE 'down' END, 1L FROM symbols_view s, LATERAL macro_latest(s.symbol) f
 UNION ALL SELECT 'holding', s.symbol, string(bigint(f.quantity)), 1L FROM symbols_view s, LATERAL holding(s.symbol) f
 UNION ALL SELECT 'search_nodes', id, canonical_name, 1L FROM search_nodes('ring', 20)""")


@query("batch_score", "SELECT doc_id, CAST(length(text) % 7 AS DOUBLE) AS score FROM documents")
def batch_score(m):
    """Injected batch scorer over whole texts"""
    return C.batch_score(m.table("documents"), lambda t: t.str.len() % 7, "doc_id", "text")


@query("gather_results", """SELECT s.symbol AS ticker, 'news=' || coalesce(CAST(q.n AS VARCHAR),'no result') || '|signal=' || s.act || '|weather=no result' AS results FROM simple s LEFT JOIN sent0 q ON q.ticker=s.symbol""")
def gather_results(m):
    """Plan rows executed against the result tables"""
    from .news_queries import items, N
    plan = m.symbols.select(c("symbol").alias("ticker"), F.explode(F.array(F.lit("signal"), F.lit("news"), F.lit("weather"))).alias("function"))
    sig = S.simple_signals(m.bars).select("ticker", c("suggested_action").alias("value"))
    news = N.sentiment(items(m)).select("ticker", c("articles_found").cast("string").alias("value"))
    return C.gather(plan, {"signal": sig, "news": news}).withColumn("results", F.array_join("results", "|"))
