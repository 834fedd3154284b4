"""Indicator queries over the whole bar panel."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.numeric import day, rnd
from ..operators import indicators as I
from .registry import query

c = F.col


def KEY():
    return [c("symbol"), day(c("ts")).alias("ts")]


SKEY = "symbol, strftime(ts,'%Y-%m-%d') AS ts"


def _window(m, build, extra=None):
    """select key + windowed columns from the clustered panel"""
    ind = I.Ind()
    bars = I.prepared(m.bars)
    if extra:
        bars = extra(bars, ind)
    cols = build(ind)
    return ind.apply(bars, cols).select(*KEY(), *cols)


def _win_query(name, build, sql, extra=None):
    query(name, sql)(lambda m: _window(m, build, extra))


def _gate(expr, n, over=None):
    return f"CASE WHEN i>={n-1} THEN {expr} OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {n-1} PRECEDING AND CURRENT ROW) END"


W = "OVER (PARTITION BY symbol ORDER BY i)"
CUM = "OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

_win_query("ind_sma", lambda x: {f"sma{n}": rnd(x.sma(n), 4) for n in (20, 50, 200)},
           f"SELECT {SKEY}, R4({_gate('avg(close)', 20)}) AS sma20, R4({_gate('avg(close)', 50)}) AS sma50, R4({_gate('avg(close)', 200)}) AS sma200 FROM pb")
_win_query("ind_bbands", lambda x: {k: rnd(v, 4) for k, v in x.bollinger().items()},
           f"""SELECT {SKEY}, R4(m) AS bb_mid, R4(m+2*s) AS bb_upper, R4(m-2*s) AS bb_lower,
 R4(CASE WHEN s<>0 THEN (close-(m-2*s))/((m+2*s)-(m-2*s)) END) AS bb_pctb, R4(((m+2*s)-(m-2*s))/m) AS bb_width
 FROM (SELECT *, {_gate('avg(close)', 20)} AS m, {_gate('stddev_pop(close)', 20)} AS s FROM pb)""")
_win_query("ind_cci", lambda x: {"cci": rnd(x.cci(), 3)},
           """SELECT p.symbol, strftime(p.ts,'%Y-%m-%d') AS ts, R3(CASE WHEN p.i>=19 THEN CASE WHEN d.dev>0 THEN (p.tp-d.mean)/(0.015*d.dev) ELSE 0 END END) AS cci
 FROM pb p LEFT JOIN (SELECT symbol, i, avg(abs(q-mean)) AS dev, any_value(mean) AS mean FROM (
   SELECT a.symbol, a.i, b.tp AS q, avg(b.tp) OVER (PARTITION BY a.symbol, a.i) AS mean
   FROM pb a JOIN pb b ON b.symbol=a.symbol AND b.i BETWEEN a.i-19 AND a.i) GROUP BY 1,2) d USING (symbol, i)""")
_win_query("ind_roc", lambda x: {"roc": rnd(x.roc(), 4)},
           f"SELECT {SKEY}, R4(100*(close/lag(close,10) {W} - 1)) AS roc FROM pb")
_win_query("ind_mom", lambda x: {"mom": rnd(x.mom(), 4)},
           f"SELECT {SKEY}, R4(close-lag(close,10) {W}) AS mom FROM pb")
_win_query("ind_willr", lambda x: {"willr": rnd(x.willr(), 4)},
           f"""SELECT {SKEY}, R4(CASE WHEN hh>ll THEN -100*(hh-close)/(hh-ll) WHEN hh IS NOT NULL THEN 0 END) AS willr
 FROM (SELECT *, {_gate('max(high)', 14)} AS hh, {_gate('min(low)', 14)} AS ll FROM pb)""")
_win_query("ind_obv", lambda x: {"obv": rnd(x.obv(), 3)},
           f"SELECT {SKEY}, R3(sum(sg*volume) {CUM}) AS obv FROM (SELECT *, CASE WHEN pc IS NULL THEN 1 ELSE sign(close-pc) END AS sg FROM pb)")
_win_query("ind_ad", lambda x: {"ad": rnd(x.ad_line(), 3)},
           f"SELECT {SKEY}, R3(sum(coalesce(mfm,0)*volume) {CUM}) AS ad FROM pb")
_win_query("ind_cmf", lambda x: {"cmf": rnd(x.cmf(), 5)},
           """SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, R5(CASE WHEN count(mfm) OVER w = 20 THEN sum(mfm*volume) OVER w / sum(volume) OVER w END) AS cmf
 FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
_win_query("ind_vwap", lambda x: {"vwap": rnd(x.vwap(), 4)},
           f"SELECT {SKEY}, R4(sum(tp*volume) {CUM} / sum(volume) {CUM}) AS vwap FROM pb")
_win_query("ind_mfi", lambda x: {"mfi": rnd(I.mfi(x), 4)},
           """SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, R4(CASE WHEN i>=14 THEN CASE WHEN p+q<1 THEN 0 ELSE 100*p/(p+q) END END) AS mfi FROM (
 SELECT symbol, ts, i, sum(CASE WHEN tp>ptp THEN tp*volume ELSE 0 END) OVER w AS p, sum(CASE WHEN tp<ptp THEN tp*volume ELSE 0 END) OVER w AS q
 FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))""",
           extra=I.with_tp_flow)
_win_query("ind_vol_ratio", lambda x: {"vol_ratio": rnd(x.vol_ratio(), 5)},
           f"SELECT {SKEY}, R5(volume/v) AS vol_ratio FROM (SELECT *, {_gate('avg(volume)', 20)} AS v FROM pb)")
_win_query("ind_abs_ret", lambda x: {"abs_ret5": rnd(x.over(F.avg("chg"), 5, first=5), 6)},
           """SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, R6(CASE WHEN i>=5 THEN avg(abs(close/pc-1)) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END) AS abs_ret5 FROM pb""",
           extra=lambda b, x: b.withColumn("chg", F.abs(c("close") / c("prev_close") - 1)))
_win_query("ind_std5", lambda x: {"std5": rnd(x.std(5), 4)},
           f"SELECT {SKEY}, R4({_gate('stddev_pop(close)', 5)}) AS std5 FROM pb")


@query("support_resistance", """SELECT symbol, min(low) AS support, max(high) AS resistance FROM pb WHERE i >= n-50 GROUP BY symbol""")
def support_resistance(m):
    """Lowest low and highest high of the last 50 bars per symbol"""
    return I.last_n(m.bars, 50).groupBy("symbol").agg(
        F.min("low").alias("support"), F.max("high").alias("resistance"))


def _kernel(m, wanted, digits=4):
    d = I.kernels(I.clustered(m.bars), wanted)
    return d.select(*KEY(), *[rnd(c(w), digits).alias(w) for w in wanted])


def _kernel_query(name, wanted, sql_cols, digits=4):
    cols = ", ".join(f"R{digits}(d.{s}) AS {w}" for w, s in zip(wanted, sql_cols))
    query(name, f"SELECT p.symbol, strftime(p.ts,'%Y-%m-%d') AS ts, {cols} FROM ind d JOIN pb p USING (symbol, i)")(
        lambda m: _kernel(m, wanted, digits))


_kernel_query("ind_ema", ["ema20", "ema50", "ema200"], ["e20", "e50", "e200"])
_kernel_query("ind_slope", ["slope20", "slope50", "slope200"], ["sl20", "sl50", "sl200"])
_kernel_query("ind_macd", ["macd", "macd_signal", "macd_hist"], ["macd", "macd_signal", "hist"])
_kernel_query("ind_supertrend", ["supertrend", "supertrend_seeded"], ["st", "st_seeded"])
_kernel_query("ind_adx", ["adx"], ["adx"])
_kernel_query("ind_rsi", ["rsi"], ["rsi"])
_kernel_query("ind_stochrsi", ["stoch_rsi"], ["stoch_rsi"], digits=3)


@query("ind_atr", """SELECT p.symbol, strftime(p.ts,'%Y-%m-%d') AS ts, R4(x.tr) AS tr, R4(d.atr14) AS atr14, R4(d.atr10) AS atr10
 FROM ind d JOIN pb p USING (symbol, i) JOIN ind_x x USING (symbol, i)""")
def ind_atr(m):
    """True range by window, Wilder averages by kernel on the same layout"""
    base = I.prepared(m.bars).withColumn("tr", I.Ind().true_range())
    d = I.kernels(base, ["atr14", "atr10"], keep=["tr"])
    return d.select(*KEY(), *[rnd(c(x), 4).alias(x) for x in ("tr", "atr14", "atr10")])


@query("ind_di", """SELECT p.symbol, strftime(p.ts,'%Y-%m-%d') AS ts, R4(d.pdi) AS plus_di, R4(d.mdi) AS minus_di, R4(d.pdi-d.mdi) AS di_diff FROM ind d JOIN pb p USING (symbol, i)""")
def ind_di(m):
    """Directional indicators and their difference"""
    d = I.kernels(I.clustered(m.bars), ["plus_di", "minus_di"])
    return d.select(*KEY(), rnd(c("plus_di"), 4).alias("plus_di"), rnd(c("minus_di"), 4).alias("minus_di"),
                    rnd(c("plus_di") - c("minus_di"), 4).alias("di_diff"))


def band_break(close="close"):
    mid = (c("high") + c("low")) / 2
    return (F.when(c(close) > mid + 3 * c("atr10"), 1.0)
            .when(c(close) < mid - 3 * c("atr10"), -1.0).otherwise(0.0))


@query("ind_band_break", """SELECT p.symbol, strftime(p.ts,'%Y-%m-%d') AS ts, CAST(CASE WHEN p.close > (p.high+p.low)/2 + 3*d.atr10 THEN 1
 WHEN p.close < (p.high+p.low)/2 - 3*d.atr10 THEN -1 ELSE 0 END AS DOUBLE) AS band_break FROM ind d JOIN pb p USING (symbol, i)""")
def ind_band_break(m):
    """Close outside the mid-price plus or minus three ATR(10)"""
    return I.kernels(I.clustered(m.bars), ["atr10"]).select(*KEY(), band_break().alias("band_break"))


@query("series_scale", """SELECT p.symbol, strftime(p.ts,'%Y-%m-%d') AS ts, R4(CASE WHEN s>0 THEN roc/(s+1e-9) ELSE coalesce(roc,0) END) AS scaled
 FROM (SELECT *, stddev_samp(roc) OVER (PARTITION BY symbol) AS s FROM (SELECT symbol, ts, i, 100*(close/lag(close,10) OVER (PARTITION BY symbol ORDER BY i) - 1) AS roc FROM pb)) p""")
def series_scale(m):
    """Rate of change divided by its own full-history deviation"""
    ind = I.Ind()
    d = ind.apply(I.prepared(m.bars), {"roc": ind.roc()})
    return d.select(*KEY(), rnd(I.scaled("roc"), 4).alias("scaled"))


@query("pct_rank_avg", f"""WITH b AS (SELECT symbol, ts, i, n, 4*s/m AS bw FROM (SELECT *, {_gate('avg(close)', 20)} AS m, {_gate('stddev_pop(close)', 20)} AS s FROM pb))
 SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, R6(bw_pct) AS bw_pct FROM (SELECT l.symbol, l.ts,
  ((SELECT count(*) FROM b WHERE b.symbol=l.symbol AND b.bw < l.bw) + ((SELECT count(*) FROM b WHERE b.symbol=l.symbol AND b.bw = l.bw)+1)/2.0) / (SELECT count(bw) FROM b WHERE b.symbol=l.symbol) AS bw_pct
  FROM b l WHERE l.i = l.n-1)""")
def pct_rank_avg(m):
    """Percentile rank of the newest Bollinger width in its history"""
    ind = I.Ind()
    d = ind.apply(I.prepared(m.bars, total=True), {"bw": 4 * ind.over(F.stddev_pop("close"), 20) / ind.sma(20)})
    return (I.newest_pct_rank(d, "bw").where(c("i") == c("n") - 1)
            .select(*KEY(), rnd(c("bw_pct"), 6).alias("bw_pct")))


@query("atr_p10", "SELECT symbol, R4(quantile_cont(atr14, 0.1)) AS atr_p10 FROM ind GROUP BY symbol")
def atr_p10(m):
    """Linear-interpolated 10th percentile of ATR(14)"""
    return (I.kernels(I.clustered(m.bars), ["atr14"]).groupBy("symbol")
            .agg(rnd(F.percentile("atr14", 0.1), 4).alias("atr_p10")))
