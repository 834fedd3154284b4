"""Pattern queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns as P
from .oracle import fragment
from .registry import query

c = F.col
COLS = ["symbol", "name", "direction", "strength", "date"]


def _reg(name, groups, fragment_name, *more):
    query(name, f"SELECT {', '.join([*COLS, *more])} FROM {fragment_name}")(
        lambda m: P.pattern_rows(P.latest_patterns(m.bars, groups)).select(*COLS, *more))


def _hits(tests, src, date="strftime(ts,'%Y-%m-%d')"):
    return " UNION ALL ".join(
        f"SELECT symbol, '{n}' AS name, {w if w.startswith('CASE') else repr(w)} AS direction, CAST({s} AS DOUBLE) AS strength, {date} AS date, {r} AS rank FROM {src} WHERE {t}"
        for n, w, s, r, t in tests)


fragment("pbb", """SELECT l.*, b.cnt, (b.below + (b.ties+1)/2.0)/b.cnt AS pct FROM wnd l JOIN (
 SELECT x.symbol, count(*) AS cnt, count(*) FILTER (x.sd20*4/x.sma20 < z.bw) AS below, count(*) FILTER (x.sd20*4/x.sma20 = z.bw) AS ties
 FROM wnd x JOIN (SELECT symbol, sd20*4/sma20 AS bw FROM wnd WHERE i=n-1) z USING (symbol) WHERE x.sd20 IS NOT NULL GROUP BY 1) b USING (symbol) WHERE l.i=l.n-1""")
fragment("p_bb", _hits([
    ("Bollinger Squeeze", "neutral", 0.7, 0, "cnt>=20 AND pct<0.2"),
    ("Bollinger Breakout (Upper)", "bearish", 0.6, 1, "cnt>=20 AND pct>=0.2 AND close>sma20+2*sd20"),
    ("Bollinger Breakdown (Lower)", "bullish", 0.6, 2, "cnt>=20 AND pct>=0.2 AND close<sma20-2*sd20")], "pbb"))
fragment("plast", "SELECT d.*, p.ts, p.n FROM ind d JOIN pb p USING (symbol, i) WHERE d.i=p.n-1")
fragment("p_macd", _hits([
    ("MACD Bullish Crossover", "bullish", 0.75, 3, "hist_prev<0 AND hist>0"),
    ("MACD Bearish Crossover", "bearish", 0.75, 4, "hist_prev>0 AND hist<0")], "plast"))
fragment("pcross", "SELECT * FROM (SELECT symbol, ts, i, n, sma50-sma200 AS gap, lag(sma50-sma200) OVER (PARTITION BY symbol ORDER BY i) AS pgap FROM wnd) WHERE i=n-1")
fragment("p_cross", _hits([
    ("Golden Cross", "bullish", 0.9, 5, "pgap<0 AND gap>0"), ("Death Cross", "bearish", 0.9, 6, "pgap>0 AND gap<0")], "pcross"))
fragment("p_rsi", _hits([
    ("RSI Overbought", "bearish", 0.65, 7, "rsi>75"), ("RSI Oversold", "bullish", 0.65, 8, "rsi<25")], "plast"))
fragment("pvol", "SELECT p.*, (SELECT avg(q.volume) FROM pb q WHERE q.symbol=p.symbol AND q.i>p.i-20) AS vm FROM pb p WHERE p.i=p.n-1 AND p.n>=20")
fragment("p_vol", _hits([("Volume Spike", "CASE WHEN close>pc THEN 'bullish' ELSE 'bearish' END", 0.8, 9, "vm>0 AND volume>2.5*vm")], "pvol"))

fragment("cdl0", """SELECT symbol, ts, i, n, open o, high h, low l, close c, abs(close-open) body, high-greatest(open,close) us, least(open,close)-low ls, close>=open wh,
 avg(abs(close-open)) OVER p10 ab, 0.1*avg(high-low) OVER p10 thin, 0.2*avg(high-low) OVER p5 near, 0.6*avg(high-low) OVER p5 far
FROM pb WINDOW p10 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), p5 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
fragment("cdl", """SELECT a.symbol, a.ts, a.i, a.n, a.o, a.h, a.l, a.c, a.body, a.us, a.ls, a.wh, a.ab, a.thin,
 b.o o1, b.h h1, b.l l1, b.c c1, b.body body1, b.us us1, b.ls ls1, b.wh wh1, b.ab ab1, b.thin thin1, b.near near1, b.far far1,
 d.o o2, d.c c2, d.body body2, d.us us2, d.ls ls2, d.wh wh2, d.ab ab2, d.thin thin2, d.near near2, d.far far2, e.h h3, e.wh wh3
FROM cdl0 a LEFT JOIN cdl0 b ON b.symbol=a.symbol AND b.i=a.i-1 LEFT JOIN cdl0 d ON d.symbol=a.symbol AND d.i=a.i-2 LEFT JOIN cdl0 e ON e.symbol=a.symbol AND e.i=a.i-3 WHERE a.i=a.n-1""")
fragment("p_cdl", _hits([
    ("Hammer", "bullish", 0.7, 10, "i>=11 AND body<ab AND ls>body AND us<thin AND least(o,c)<=l1+near1"),
    ("Shooting Star", "bearish", 0.7, 11, "i>=11 AND body<ab AND us>body AND ls<thin AND least(o,c)>greatest(o1,c1)"),
    ("Doji", "neutral", 0.7, 12, "i>=10 AND body<=thin"),
    ("Engulfing Bull", "bullish", 0.7, 13, """i>=2 AND ((wh AND NOT wh1 AND ((c>=o1 AND o<c1) OR (c>o1 AND o<=c1))) OR (NOT wh AND wh1 AND ((o>=c1 AND c<o1) OR (o>c1 AND c<=o1))))"""),
    ("Morning Star", "bullish", 0.7, 14, "i>=12 AND body2>ab2 AND body1<=ab1 AND body>ab AND NOT wh2 AND greatest(o1,c1)<least(o2,c2) AND wh AND c>c2+0.3*body2"),
    ("Evening Star", "bearish", 0.7, 15, "i>=12 AND body2>ab2 AND body1<=ab1 AND body>ab AND wh2 AND least(o1,c1)>greatest(o2,c2) AND NOT wh AND c<c2-0.3*body2"),
    ("Three White Soldiers", "bullish", 0.7, 16, """i>=12 AND wh AND wh1 AND wh2 AND us<thin AND us1<thin1 AND us2<thin2 AND c>c1 AND c1>c2 AND o1>o2 AND o1<=c2+near2
 AND o>o1 AND o<=c1+near1 AND body1>body2-far2 AND body>body1-far1 AND body>ab"""),
    ("Three Black Crows", "bearish", 0.7, 17, """i>=13 AND wh3 AND NOT wh2 AND NOT wh1 AND NOT wh AND ls2<thin2 AND ls1<thin1 AND ls<thin AND o1<o2 AND o1>c2 AND o<o1 AND o>c1
 AND h3>c2 AND c2>c1 AND c1>c""")], "cdl"))

fragment("stc", """SELECT *, CASE WHEN i>=2 THEN max(high) OVER w3 END hi, CASE WHEN i>=2 THEN min(low) OVER w3 END lo, CASE WHEN i>=2 THEN max(close) OVER w3 END ch, CASE WHEN i>=2 THEN min(close) OVER w3 END cl,
 lead(high) OVER w nh, lead(low) OVER w nl, sign(high-lag(high,2) OVER w) th, sign(low-lag(low,2) OVER w) tl
FROM pb WINDOW w AS (PARTITION BY symbol ORDER BY i), w3 AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
_CALM = "(ph-pl)<=0.05*(ph+pl)/2 AND (nh-nl)<=0.05*(nh+nl)/2"
_PAIRS = [
    ("Head and Shoulder", "hi>ph AND hi>nh AND high<ph AND high<nh", "Inverse Head and Shoulder", "lo<pl AND lo<nl AND low>pl AND low>nl"),
    ("Multiple Top", "hi>=ph AND ch<pc", "Multiple Bottom", "lo<=pl AND cl>pc"),
    ("Ascending Triangle", "hi>=ph AND lo<=pl AND close>pc", "Descending Triangle", "hi>=ph AND lo<=pl AND close<pc"),
    ("Wedge Up", "hi>=ph AND lo<=pl AND th=1 AND tl=1", "Wedge Down", "hi<=ph AND lo>=pl AND th=-1 AND tl=-1"),
    ("Channel Up", "hi>=ph AND lo<=pl AND hi-lo<=0.1*(hi+lo)/2 AND th=1 AND tl=1", "Channel Down", "hi<=ph AND lo>=pl AND hi-lo<=0.1*(hi+lo)/2 AND th=-1 AND tl=-1"),
    ("Double Top", f"hi>=ph AND hi>=nh AND high<ph AND high<nh AND {_CALM}", "Double Bottom", f"lo<=pl AND lo<=nl AND low>pl AND low>nl AND {_CALM}"),
]
fragment("stl", " UNION ALL ".join(
    f"SELECT symbol, i, ts, {k} AS det, CASE WHEN {t2} THEN '{n2}' WHEN {t1} THEN '{n1}' END AS name FROM stc WHERE i>=n-20"
    for k, (n1, t1, n2, t2) in enumerate(_PAIRS)))
_DIR = "CASE name " + " ".join(f"WHEN '{n}' THEN '{w}'" for n, w, _, _ in P.PATTERNS if w) + " END"
_RANK = "CASE name " + " ".join(f"WHEN '{n}' THEN {k}" for k, (n, *_) in enumerate(P.PATTERNS)) + " END"
fragment("p_stc", f"""SELECT symbol, name, {_DIR} AS direction, CAST(0.8 AS DOUBLE) AS strength, strftime(ts,'%Y-%m-%d') AS date, {_RANK} AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY symbol, det ORDER BY i DESC) AS r FROM stl WHERE name IS NOT NULL) WHERE r=1""")
_UNION = " UNION ALL ".join(f"SELECT * FROM {x}" for x in ("p_bb", "p_macd", "p_cross", "p_rsi", "p_vol", "p_cdl"))
fragment("p_point", _UNION)
fragment("p_best", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY strength DESC, rank) AS r FROM (SELECT * FROM p_point UNION ALL SELECT * FROM p_stc)) WHERE r=1")

_reg("pat_bollinger", (P.Bollinger,), "p_bb")
_reg("pat_macd_cross", (P.MacdCross,), "p_macd")
_reg("pat_ma_cross", (P.AverageCross,), "p_cross")
_reg("pat_rsi", (P.Rsi,), "(SELECT h.*, 'RSI at ' || printf('%.1f', l.rsi) || CASE WHEN l.rsi>75 THEN ' — overbought, risk of reversal.' ELSE ' — oversold, bounce opportunity.' END AS explanation FROM p_rsi h JOIN plast l USING (symbol))", "explanation")
_reg("pat_volume", (P.VolumeSpike,), "(SELECT h.*, 'Volume ' || printf('%.1f', v.volume/v.vm) || 'x above 20d avg — strong institutional interest.' AS explanation FROM p_vol h JOIN pvol v USING (symbol))", "explanation")
_reg("pat_candles", (P.Candles,), "p_cdl")
_reg("pat_structural", (P.Structural,), "p_stc")
_reg("pat_all", P.POINTWISE, "p_point")


@query("pat_best", "SELECT symbol, name, direction, strength, date FROM p_best")
def pat_best(m):
    """Strongest pattern per symbol"""
    return P.pattern_rows(P.latest_patterns(m.bars, best=True)).select(*COLS)
