"""Scores, regimes, signals and strategy evaluation queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import day, nz, rnd
from ..operators import evaluation as E, indicators as I, signals as S
from .oracle import fragment, recursions
from .registry import query

c = F.col

fragment("wnd", """
SELECT *, CASE WHEN i>=19 THEN avg(close) OVER w20 END AS sma20, CASE WHEN i>=49 THEN avg(close) OVER w50 END AS sma50,
 CASE WHEN i>=199 THEN avg(close) OVER w200 END AS sma200, CASE WHEN i>=19 THEN stddev_pop(close) OVER w20 END AS sd20,
 min(low) OVER w50 AS support, max(high) OVER w50 AS resistance
FROM pb WINDOW w20 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
 w50 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
 w200 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""")

fragment("comp", """
SELECT symbol, i, n, ts, open, close, pc, support, resistance, sma50, sma200, adx, macd_part, CAST(1 AS DOUBLE) AS trend_part,
  coalesce(sign(pdi-mdi),0)*strength*0.5 AS adx_part,
  CASE WHEN sd20<>0 AND abs(off)>0.3 THEN off*-2.0 ELSE 0 END * 0.5 * (1-strength) AS band_part
FROM (SELECT w.*, d.adx, d.pdi, d.mdi,
   coalesce(CASE WHEN d.atr14<>0 THEN CASE WHEN d.hist/d.atr14 < -1 THEN -1 WHEN d.hist/d.atr14 > 1 THEN 1 ELSE d.hist/d.atr14 END END, 0) AS macd_part,
   coalesce(CASE WHEN (d.adx-15)/25 < 0 THEN 0 WHEN (d.adx-15)/25 > 1 THEN 1 ELSE (d.adx-15)/25 END, 0) AS strength,
   (w.close-(w.sma20-2*w.sd20))/((w.sma20+2*w.sd20)-(w.sma20-2*w.sd20)) - 0.5 AS off
 FROM wnd w JOIN ind d USING (symbol, i))""")

fragment("simple", """
SELECT *, CASE WHEN act='BUY' THEN (60+40*(1-exp(-0.7*greatest(score-1.5,0))))/100 WHEN act='SELL' THEN (60+40*(1-exp(-0.7*greatest(-score,0))))/100 ELSE 0.5 END AS conf,
 CASE WHEN pc>0 THEN R2((close-pc)/pc*100) END AS pct
FROM (SELECT *, CASE WHEN score>=1.5 THEN 'BUY' WHEN score<=-1.0 THEN 'SELL' ELSE 'HOLD' END AS act FROM (
 SELECT symbol, ts, n, close, pc, support, resistance, R4(macd_part) AS mp, trend_part AS tp, R4(adx_part) AS ap, R4(band_part) AS bp,
  R4(R4(macd_part)+trend_part+R4(adx_part)+R4(band_part)) AS score,
  CASE WHEN sma50 IS NULL OR sma200 IS NULL OR adx IS NULL THEN 'NEUTRAL' WHEN sma50>sma200 AND adx>20 THEN 'UPTREND'
   WHEN sma50<sma200 AND adx>20 THEN 'DOWNTREND' WHEN adx<15 THEN 'RANGING' ELSE 'MIXED' END AS trend_state
 FROM comp WHERE i=n-1 AND n>=60))""")

DAY = "strftime(ts,'%Y-%m-%d') AS ts"
for _name, _part in (("score_macd", "macd_part"), ("score_adx", "adx_part"), ("score_bb", "band_part")):
    query(_name, f"SELECT symbol, {DAY}, R4({_part}) AS score FROM comp")(
        lambda m, p=_part: S.component_panel(m.bars).select("symbol", day(c("ts")).alias("ts"), rnd(c(p), 4).alias("score")))


@query("score_series", f"SELECT symbol, {DAY}, R4(macd_part+trend_part+adx_part+band_part) AS score FROM comp")
def score_series(m):
    """Composite score of every bar"""
    return S.component_panel(m.bars).select("symbol", day(c("ts")).alias("ts"), rnd(S.bar_score(), 4).alias("score"))


@query("score_latest", "SELECT symbol, mp AS macd_part, tp AS trend_part, ap AS adx_part, bp AS band_part, score FROM simple")
def score_latest(m):
    """Newest score from rounded components"""
    return S.latest_components(m.bars, 60).select("symbol", *S.PARTS, rnd(c("score"), 4).alias("score"))


@query("trend_state", "SELECT symbol, trend_state FROM simple")
def trend_state(m):
    """Trend label from SMA50/200 and ADX"""
    return S.latest_components(m.bars, 60).select("symbol", S.trend_state().alias("trend_state"))


@query("signal_simple", f"""SELECT symbol AS ticker, {DAY}, score, trend_state AS regime, 1.5::DOUBLE AS threshold, act AS suggested_action,
 R4(conf) AS confidence, close AS last_close, pc AS prev_close, pct AS pct_change, R2(support) AS support, R2(resistance) AS resistance,
 R4(abs(score)*R4(conf)) AS conviction FROM simple""")
def signal_simple(m):
    """Flagship: newest simple-engine signal per symbol"""
    d = S.simple_signals(m.bars)
    return (d.withColumn("conviction", rnd(F.abs(c("score")) * c("confidence"), 4)).withColumn("ts", day(c("ts")))
            .drop("component_scores", "regime_desc").orderBy(c("conviction").desc(), "ticker"))


# ── regime engine ───────────────────────────────────────────────────────────────────
fragment("fct", """
SELECT *, CASE WHEN i>=19 THEN avg(tp) OVER w20 END AS tpm, avg(volume) OVER w20 AS vm,
  100*(close/lag(close,10) OVER w - 1) AS roc, close-lag(close,10) OVER w AS mom,
  max(high) OVER w14 AS hh, min(low) OVER w14 AS ll, stddev_pop(close) OVER w5 AS std5,
  sum(CASE WHEN pc IS NULL THEN 1 ELSE sign(close-pc) END * volume) OVER cum AS obv, sum(coalesce(mfm,0)*volume) OVER cum AS ad,
  CASE WHEN count(mfm) OVER w20 = 20 THEN sum(mfm*volume) OVER w20 / sum(volume) OVER w20 END AS cmf,
  sum(tp*volume) OVER cum / sum(volume) OVER cum AS vwap,
  sum(CASE WHEN tp>ptp THEN tp*volume ELSE 0 END) OVER w14 AS mfp, sum(CASE WHEN tp<ptp THEN tp*volume ELSE 0 END) OVER w14 AS mfn
FROM wnd WINDOW w AS (PARTITION BY symbol ORDER BY i),
 w5 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
 w14 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
 w20 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
 cum AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
fragment("fct2", """
SELECT f.*, d.stoch_rsi, d.macd, d.macd_signal, d.hist, d.pdi-d.mdi AS di, d.adx, d.atr10, d.sl20, d.sl50, d.sl200,
 lag(f.sma20+2*f.sd20) OVER w AS pup, lag(f.sma20-2*f.sd20) OVER w AS plo, lag(f.obv) OVER w AS obv1, lag(f.obv,4) OVER w AS obv4, lag(f.ad) OVER w AS ad1,
 (SELECT avg(abs(q.tp-f.tpm)) FROM pb q WHERE q.symbol=f.symbol AND q.i BETWEEN f.i-19 AND f.i AND f.i=f.n-1) AS dev
FROM fct f JOIN ind d USING (symbol, i) WINDOW w AS (PARTITION BY f.symbol ORDER BY f.i)""")
fragment("fsd", """SELECT symbol, stddev_samp(hist) h, stddev_samp(pdi-mdi) d, stddev_samp(sl20) s20, stddev_samp(sl50) s50, stddev_samp(sl200) s200 FROM ind GROUP BY symbol""")
fragment("factors", """
SELECT l.symbol, l.n, l.close, l.pc,
 CASE WHEN l.n<200 THEN 0 ELSE (CASE WHEN l.stoch_rsi>0.8 THEN -1 WHEN l.stoch_rsi<0.2 THEN 1 ELSE 0 END)
  + (CASE WHEN l.dev>0 AND (l.tp-l.tpm)/(0.015*l.dev)>100 THEN -1 WHEN l.dev>0 AND (l.tp-l.tpm)/(0.015*l.dev)<-100 THEN 1 ELSE 0 END)
  + (CASE WHEN l.close<=l.sma20-2*l.sd20 THEN 1 WHEN l.close>=l.sma20+2*l.sd20 THEN -1 ELSE 0 END)
  + (CASE WHEN l.pc<=l.plo AND l.close>=l.sma20 THEN 1 WHEN l.pc>=l.pup AND l.close<=l.sma20 THEN -1 ELSE 0 END)
  + (CASE WHEN l.std5>3.7 THEN CASE WHEN l.sma50>l.sma200 THEN -1 ELSE 1 END ELSE 0 END)
  + (CASE WHEN (l.close-l.sma20)/l.sma20>0.05 THEN -1 WHEN (l.close-l.sma20)/l.sma20<-0.05 THEN 1 ELSE 0 END) END::DOUBLE AS meanrev,
 CASE WHEN l.n<200 THEN 0 ELSE (1.2*coalesce(l.adx/100,0) + 1.0*coalesce(l.hist/(s.h+1e-9),0) + 1.0*coalesce(l.di/(s.d+1e-9),0)
  + 0.7*CASE WHEN s.s20>0 THEN l.sl20/(s.s20+1e-9) ELSE l.sl20 END + 0.7*CASE WHEN s.s50>0 THEN l.sl50/(s.s50+1e-9) ELSE l.sl50 END
  + 1.0*CASE WHEN s.s200>0 THEN l.sl200/(s.s200+1e-9) ELSE l.sl200 END
  + 1.2*CASE WHEN l.close>(l.high+l.low)/2+3*l.atr10 THEN 1 WHEN l.close<(l.high+l.low)/2-3*l.atr10 THEN -1 ELSE 0 END)/6.8 END::DOUBLE AS trend,
 CASE WHEN l.n<20 THEN 0 ELSE (CASE WHEN l.roc>2 THEN 1 WHEN l.roc<-2 THEN -1 ELSE 0 END) + (CASE WHEN l.mom>0 THEN 1 ELSE -1 END)
  + (CASE WHEN -100*(l.hh-l.close)/(l.hh-l.ll)<-80 THEN 1 WHEN -100*(l.hh-l.close)/(l.hh-l.ll)>-20 THEN -1 ELSE 0 END)
  + (CASE WHEN l.obv>l.obv4 THEN 1 ELSE -1 END) + (CASE WHEN l.cmf IS NULL THEN 0 WHEN l.cmf>0 THEN 1 ELSE -1 END) END::DOUBLE AS momentum,
 CASE WHEN l.n<35 THEN 0 ELSE (CASE WHEN l.ad>l.ad1 THEN 1 ELSE -1 END) + (CASE WHEN l.cmf IS NULL THEN 0 WHEN l.cmf>0 THEN 1 ELSE -1 END)
  + (CASE WHEN l.obv>l.obv1 THEN 1 ELSE -1 END) + (CASE WHEN l.close>l.vwap THEN 1 ELSE -1 END)
  + (CASE WHEN l.macd>l.macd_signal THEN 1 ELSE -1 END) + (CASE WHEN 100*l.mfp/(l.mfp+l.mfn)>50 THEN 1 ELSE -1 END) END::DOUBLE AS whales
FROM fct2 l JOIN fsd s USING (symbol)
WHERE l.i=l.n-1""")

for _name, _col in (("score_meanrev", "meanrev"), ("score_trend", "trend"), ("score_momentum", "momentum"), ("score_flow", "whales")):
    query(_name, f"SELECT symbol, R5({_col}) AS score FROM factors")(
        lambda m, p=_col: S.factor_scores(m.bars, parts=(p,)).select("symbol", rnd(c(p), 5).alias("score")))

fragment("slc", """
SELECT symbol || '#' || CAST(blk AS VARCHAR) AS symbol, ts, high, low, close, volume, i - (172+blk*28) AS i, pc, ph, pl FROM (
 SELECT symbol, ts, high, low, close, volume, pc, ph, pl, i, n, CAST(floor((i-172)/28.0) AS BIGINT) AS blk FROM pb WHERE i>=172) WHERE 172+(blk+1)*28<=n""")
fragment("slast", "SELECT symbol, ts, high, low, close, volume, i-(n-28) AS i, pc, ph, pl FROM pb WHERE i>=n-28")
fragment("sasof", """
SELECT symbol, ts, high, low, close, volume, i-(m-28) AS i, pc, ph, pl FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS m FROM pb WHERE ts <= TIMESTAMP '2000-01-01') WHERE i>=m-28""")
for _src, _out in (("slc", "kslc"), ("slast", "kslast"), ("sasof", "kasof")):
    recursions(_src, _out)


def _regime_sql(src, out, full=False):
    extra = """WHEN atr/matr>1.5 AND (cl>=top60 OR cl<=bot60) THEN 'BREAKOUT' WHEN sma50>sma200 AND ret>5 AND adx>25 THEN 'UP'
  WHEN sma50<sma200 AND ret<-5 AND adx>25 THEN 'DOWN'""" if full else ""
    return f"""
SELECT q.symbol, CASE WHEN cnt<28 THEN 'RANGE' WHEN v/mv>3 AND span>2*atr THEN 'WHALE' {extra}
  WHEN abs(ret)<3 AND adx<20 THEN CASE WHEN atr<p10 THEN 'SLEEPY' ELSE 'RANGE' END
  WHEN adx<15 AND chop>0.02 THEN 'CHOPPY' ELSE 'RANGE' END AS regime
FROM (SELECT s.symbol, count(*) AS cnt, max(CASE WHEN s.i=27 THEN s.volume END) AS v, avg(s.volume) AS mv, max(CASE WHEN s.i=27 THEN s.high-s.low END) AS span,
  max(CASE WHEN s.i=27 THEN k.atr14 END) AS atr, quantile_cont(k.atr14, 0.1) AS p10, max(CASE WHEN s.i=27 THEN k.adx END) AS adx, avg(k.atr14) AS matr, max(CASE WHEN s.i=27 THEN s.close END) AS cl,
  (max(CASE WHEN s.i=27 THEN s.close END)-max(CASE WHEN s.i=0 THEN s.close END))/max(CASE WHEN s.i=0 THEN s.close END)*100 AS ret,
  avg(CASE WHEN s.i>=23 THEN abs(s.close/s.pc-1) END) AS chop
 FROM {src} s JOIN {out} k USING (symbol, i) GROUP BY s.symbol) q {"JOIN wlast z ON z.symbol=q.symbol" if full else ""}"""


fragment("wlast", """SELECT symbol, sma50, sma200, top60, bot60 FROM (SELECT *, CASE WHEN i>=59 THEN max(close) OVER w60 END AS top60, CASE WHEN i>=59 THEN min(close) OVER w60 END AS bot60
 FROM wnd WINDOW w60 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE i=n-1""")


fragment("reg_slc", _regime_sql("slc", "kslc"))
fragment("reg_last", _regime_sql("slast", "kslast"))
fragment("reg_full", _regime_sql("slast", "kslast", full=True))
fragment("reg_asof", _regime_sql("sasof", "kasof"))


@query("regime", "SELECT symbol, regime FROM reg_last")
def regime(m):
    """Market regime of the last 28 bars"""
    return S.latest_regime(m.bars)


@query("asof_slice", "SELECT symbol, regime FROM reg_asof")
def asof_slice(m):
    """Regime as of a past date: last 28 bars at or before it"""
    return S.latest_regime(m.bars, as_of="2000-01-01")


@query("regime_sticky", """SELECT split_part(symbol,'#',1) AS symbol, 199 + CAST(split_part(symbol,'#',2) AS BIGINT)*28 AS from_bar,
 226 + CAST(split_part(symbol,'#',2) AS BIGINT)*28 AS to_bar, regime FROM reg_slc""")
def regime_sticky(m):
    """Regime refreshed every 28 bars and the bars it stays valid for"""
    return S.sticky_regimes(m.bars)


_W = {k: [f"{r}" for r in v] for k, v in S.REGIME_WEIGHT.items()}


def _case(j):
    return "CASE regime " + " ".join(f"WHEN '{k}' THEN {v[j]}" for k, v in S.REGIME_WEIGHT.items()) + " ELSE 1 END"


for _name, _reg in (("regsig", "reg_last"), ("regsig_full", "reg_full")):
    fragment(_name, f"""
SELECT *, CASE WHEN score>=thr THEN 'BUY' WHEN score<=0 THEN 'SELL' ELSE 'HOLD' END AS act FROM (
 SELECT *, meanrev*{_case(0)} + trend*{_case(1)} + momentum*{_case(2)} + whales*{_case(3)} AS score,
  CAST(CASE regime {' '.join(f"WHEN '{k}' THEN {v!r}" for k, v in S.REGIME_THRESHOLD.items())} ELSE 3 END AS DOUBLE) AS thr
 FROM factors JOIN {_reg} USING (symbol))""")
_CONF = "CASE WHEN act='BUY' THEN (65+35*(1-exp(-0.7*greatest(score-thr,0))))/100 WHEN act='SELL' THEN (65+35*(1-exp(-0.7*greatest(-score,0))))/100"


@query("score_regime", "SELECT symbol, regime, R5(score) AS score FROM regsig")
def score_regime(m):
    """Factor scores weighted by regime"""
    return S.regime_scores(m.bars).select("symbol", "regime", rnd(c("score"), 5).alias("score"))


@query("signal_regime", f"""SELECT symbol AS ticker, R5(score) AS score, regime, thr AS threshold, act AS suggested_action, R5({_CONF} ELSE 0.5 END) AS confidence,
 close AS last_close, pc AS prev_close, meanrev, R5(trend) AS trend, momentum, whales FROM regsig WHERE n>=200""")
def signal_regime(m):
    """Signal record of the regime engine"""
    return S.regime_signals(m.bars).select(
        "ticker", rnd(c("score"), 5).alias("score"), "regime", "threshold", "suggested_action",
        rnd(c("confidence"), 5).alias("confidence"), "last_close", "prev_close", "meanrev",
        rnd(c("trend"), 5).alias("trend"), "momentum", "whales")


@query("confidence", f"""SELECT symbol AS ticker, act AS suggested_action, R5({_CONF} ELSE 0.5 END) AS confidence,
 R5({_CONF} ELSE greatest(0, least(1, (40+25*(score/(thr+1e-6)))/100)) END) AS linear_confidence FROM regsig WHERE n>=200""")
def confidence(m):
    """Both confidence formulas on the regime engine's scores"""
    d = S.regime_signals(m.bars)
    lin = S.linear_confidence(c("score"), c("threshold"), c("suggested_action"))
    return d.select("ticker", "suggested_action", rnd(c("confidence"), 5).alias("confidence"),
                    rnd(lin, 5).alias("linear_confidence"))


fragment("conv", """
SELECT *, CASE WHEN score>=2 THEN 'STRONG BUY' WHEN score>=1 THEN 'WEAK BUY' WHEN score<=-2 THEN 'STRONG SELL' WHEN score<=-1 THEN 'WEAK SELL' ELSE 'HOLD' END AS signal,
 R4(abs(score)*R3(R4(conf))) AS conviction FROM simple""")


@query("signals_5level", "SELECT symbol AS ticker, score, R3(R4(conf)) AS confidence, signal, conviction FROM conv ORDER BY conviction DESC, symbol LIMIT 15")
def signals_5level(m):
    """Top 15 by conviction with a five-level label"""
    return S.top_conviction(S.simple_signals(m.bars)).select("ticker", "score", "confidence", "signal", "conviction")


@query("panel_signals", "SELECT s.symbol AS ticker, s.act AS simple_action, r.act AS regime_action FROM simple s LEFT JOIN regsig r ON r.symbol=s.symbol AND r.n>=200")
def panel_signals(m):
    """Both engines over every symbol at once"""
    a = S.simple_signals(m.bars).select("ticker", c("suggested_action").alias("simple_action"))
    b = S.regime_signals(m.bars).select("ticker", c("suggested_action").alias("regime_action"))
    return a.join(b, "ticker", "left")


_PAY = """CASE WHEN s_suppkey % 7 = 0 THEN '{"ticker":"' || s_name || '","error":"no data"}' ELSE '{"ticker":"' || s_name || '","score":' || CAST(s_suppkey % 9 AS STRING) || '.5'
 || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ',"suggested_action":"buy","regime":"WHALE"' END || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE ',"confidence":0.75,"last_close":' || CAST(s_suppkey AS STRING) || '.25' END || '}' END"""


@query("signal_payload", """SELECT s_name AS ticker, (s_suppkey % 9) + CAST(0.5 AS DOUBLE) AS score, CASE WHEN s_suppkey%3=0 THEN 'RANGE' ELSE 'WHALE' END AS regime,
 CASE WHEN s_suppkey%3=0 THEN 'HOLD' ELSE 'BUY' END AS suggested_action, CAST(3 AS DOUBLE) AS threshold, CASE WHEN s_suppkey%5=0 THEN 0.5 ELSE 0.75 END::DOUBLE AS confidence,
 CASE WHEN s_suppkey%5=0 THEN 0 ELSE s_suppkey + 0.25 END::DOUBLE AS last_close FROM supplier WHERE s_suppkey%7<>0""")
def signal_payload(m):
    """External signal documents of three shapes back to rows"""
    k = F.expr("s_suppkey % 4")
    d = m.table("supplier").select(F.expr(_PAY).alias("doc"), k.alias("k"), "s_name")
    payload = d.select(F.when(c("k") == 0, F.concat(F.lit("["), c("doc"), F.lit("]")))
                       .when(c("k") == 1, F.concat(F.lit('{"'), c("s_name"), F.lit('":'), c("doc"), F.lit("}")))
                       .otherwise(c("doc")).alias("payload"))
    return S.signals_from_payload(payload).select(
        "ticker", "score", "regime", "suggested_action", "threshold", "confidence", "last_close")


# ── evaluation ──────────────────────────────────────────────────────────────────────
fragment("bt", """
SELECT *, coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY i), false) AS was FROM (
 SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)=1 AS held FROM (
  SELECT symbol, ts, i, n, open, close, pc, CASE WHEN i=n-1 OR i<40 THEN NULL WHEN macd_part+trend_part+adx_part+band_part>=0.4 THEN 1
   WHEN macd_part+trend_part+adx_part+band_part<=-0.4 THEN -1 END AS ev FROM comp WHERE n>=80))""")
fragment("btt", """
SELECT symbol, entry_bar, entry_date, exit_date, R2((o-e)/e*100) AS return_pct, R2(e) AS entry, R2(o) AS exit FROM (
 SELECT a.symbol, a.i AS entry_bar, strftime(a.ts,'%Y-%m-%d') AS entry_date, a.open AS e,
  coalesce(x.open, z.close) AS o, strftime(coalesce(x.ts, z.ts),'%Y-%m-%d') AS exit_date
 FROM bt a JOIN bt z ON z.symbol=a.symbol AND z.i=a.n-1
 LEFT JOIN bt x ON x.symbol=a.symbol AND x.i=(SELECT min(q.i) FROM bt q WHERE q.symbol=a.symbol AND q.i>a.i AND q.was AND NOT q.held)
 WHERE a.held AND NOT a.was)""")
fragment("bte", """
SELECT symbol, ts, i, n, close, 100*product(f) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value,
  close/first_value(close) OVER (PARTITION BY symbol ORDER BY i)*100 AS benchmark FROM (
 SELECT *, CASE WHEN held AND NOT was THEN 0.999*close/open WHEN held THEN close/pc WHEN was THEN open/pc*0.999 ELSE 1 END
  * CASE WHEN held AND i=n-1 THEN 0.999 ELSE 1 END AS f FROM bt)""")


@query("bt_positions", f"SELECT symbol, {DAY}, held, held AND NOT was AS entry, was AND NOT held AS exit FROM bt")
def bt_positions(m):
    """Holding state and transitions of every bar"""
    return E.positions(m.bars).select("symbol", day(c("ts")).alias("ts"), "held", "entry", "exit")


@query("bt_trades", "SELECT symbol, entry_date, exit_date, return_pct, entry, exit FROM btt")
def bt_trades(m):
    """Trade list with forced close of the open tail"""
    return E.trades(E.positions(m.bars)).drop("entry_bar")


for _frag in ("comp", "bt", "btt"):
    from .oracle import FRAGMENTS
    _t = FRAGMENTS[_frag].replace("CAST(1 AS DOUBLE) AS trend_part", "d.st_seeded AS trend_part")
    if _frag == "comp":
        _t = _t.replace("d.st_seeded AS trend_part", "st_seeded AS trend_part").replace("SELECT w.*, d.adx", "SELECT w.*, d.st_seeded, d.adx")
    import re as _re
    _t = _re.sub(r"\b(comp|bt)\b", r"\1_seeded", _t)
    fragment(f"{_frag}_seeded", _t)


@query("bt_trades_seeded", "SELECT symbol, entry_date, exit_date, return_pct, entry, exit FROM btt_seeded")
def bt_trades_seeded(m):
    """Trade list when the trend band is seeded by its first ATR"""
    return E.trades(E.positions(m.bars, seeded_supertrend=True)).drop("entry_bar")


@query("bt_equity", f"SELECT symbol, {DAY}, R3(value) AS value FROM bte")
def bt_equity(m):
    """Equity curve with commission"""
    return E.equity(E.positions(m.bars)).select("symbol", day(c("ts")).alias("ts"), rnd(c("value"), 3).alias("value"))


@query("bt_benchmark", f"SELECT symbol, {DAY}, R4(close/first_value(close) OVER (PARTITION BY symbol ORDER BY i)*100) AS benchmark FROM pb")
def bt_benchmark(m):
    """Buy-and-hold curve, 100 at the first bar"""
    d = I.clustered(m.bars).withColumn("b", c("close") / F.first("close").over(I.Ind().upto) * 100)
    return d.select("symbol", day(c("ts")).alias("ts"), rnd(c("b"), 4).alias("benchmark"))


@query("bt_sample", """SELECT p.symbol, strftime(p.ts,'%Y-%m-%d') AS ts, p.i AS bar FROM pb p WHERE n<=200 OR i=n-1 OR
 i IN (SELECT CAST(floor(k*((p.n-1)/CAST(199 AS DOUBLE))) AS BIGINT) FROM range(199) t(k))""")
def bt_sample(m):
    """Evenly spaced down-sample to 200 bars"""
    return E.sampled(I.indexed(I.clustered(m.bars))).select(
        "symbol", day(c("ts")).alias("ts"), c("i").cast("bigint").alias("bar"))


@query("bt_drawdown", "SELECT symbol, R2(max((pk-value)/pk*100)) AS max_drawdown_pct FROM (SELECT *, max(value) OVER (PARTITION BY symbol ORDER BY i) AS pk FROM bte) GROUP BY symbol")
def bt_drawdown(m):
    """Maximum drawdown"""
    return _metrics(m).select("symbol", "max_drawdown_pct")


def _metrics(m):
    return E.metrics(E.equity(E.positions(m.bars)))


@query("bt_metrics", """SELECT g.symbol, R2(final-100) AS total_return_pct, R2((pow(final/100, 252.0/n)-1)*100) AS cagr_pct, R1(coalesce(wins,0)*100) AS win_rate,
 R2(dd) AS max_drawdown_pct, R2(CASE WHEN sd>0 THEN mu/sd*sqrt(252) ELSE 0 END) AS sharpe, coalesce(nt,0) AS num_trades, R2(bench-100) AS benchmark_return_pct
FROM (SELECT symbol, max(n) AS n, max(CASE WHEN i=n-1 THEN value END) AS final, max(CASE WHEN i=n-1 THEN benchmark END) AS bench, max((pk-value)/pk*100) AS dd, avg(ret) AS mu, stddev_pop(ret) AS sd
 FROM (SELECT *, max(value) OVER (PARTITION BY symbol ORDER BY i) AS pk, value/lag(value) OVER (PARTITION BY symbol ORDER BY i)-1 AS ret FROM bte) GROUP BY symbol) g
LEFT JOIN (SELECT symbol, count(*) AS nt, avg(CASE WHEN return_pct>0 THEN 1.0 ELSE 0.0 END) AS wins FROM btt GROUP BY symbol) t USING (symbol)""")
def bt_metrics(m):
    """Performance row per symbol"""
    return _metrics(m)


@query("next_open", f"SELECT symbol, {DAY}, close, lead(open) OVER (PARTITION BY symbol ORDER BY i) AS next_open FROM pb")
def next_open(m):
    """Execution price of a signal: the next bar's open"""
    d = I.clustered(m.bars).withColumn("next_open", F.lead("open").over(I.by_time()))
    return d.select("symbol", day(c("ts")).alias("ts"), "close", "next_open")


@query("lastn_per_group", "SELECT symbol, entry_date, return_pct FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_bar DESC) AS r FROM btt) WHERE r<=20")
def lastn_per_group(m):
    """Last 20 trades per symbol"""
    return E.last_trades(E.trades(E.positions(m.bars))).select("symbol", "entry_date", "return_pct")
