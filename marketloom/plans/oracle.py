"""Independent SQL definitions the driver runs beside every Spark query.

`FRAGMENTS` are named common table expressions; `build` prepends the ones a statement
mentions, in dependency order.  `R2(x)`, `R4(x)`, ... is half-up rounding in plain doubles.
"""
from __future__ import annotations

import re

FRAGMENTS: dict[str, str] = {}


def fragment(name: str, sql: str) -> None:
    FRAGMENTS[name] = sql.strip()


def _expand(sql: str) -> str:
    pat = re.compile(r"\bR(\d)\(")
    while True:
        m = pat.search(sql)
        if not m:
            return sql
        depth, k = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner, scale = sql[m.end():k - 1], 10 ** int(m.group(1))
        sql = f"{sql[:m.start()]}(floor(({inner})*CAST({scale} AS DOUBLE)+CAST(0.5 AS DOUBLE))/CAST({scale} AS DOUBLE)){sql[k:]}"


def build(sql: str) -> str:
    need: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for name in FRAGMENTS:
            if name != own and name not in need and re.search(rf"\b{name}\b", text):
                visit(FRAGMENTS[name], name)
                if name not in need:
                    need.append(name)

    visit(sql)
    sql = sql.strip()
    if not need:
        return _expand(sql)
    parts = []
    for n in need:
        body = FRAGMENTS[n]
        recursive = body.startswith("RECURSIVE")
        body = body[len("RECURSIVE"):] if recursive else body
        parts.append(f"{n} AS ({body})" if recursive else f"{n} AS MATERIALIZED ({body})")
    if sql.upper().startswith("WITH "):
        rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", sql, flags=re.I)
        return _expand("WITH RECURSIVE " + ",\n".join(parts) + ",\n" + rest)
    return _expand("WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql)


# ── bars ────────────────────────────────────────────────────────────────────────────
fragment("bars", """
SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, date_trunc('week', l_shipdate) AS ts,
  arg_min(l_extendedprice/l_quantity, k) AS open,
  max(l_extendedprice/l_quantity) AS high, min(l_extendedprice/l_quantity) AS low,
  arg_max(l_extendedprice/l_quantity, k) AS close,
  sum(l_quantity) AS volume
FROM (SELECT *, (isodow(l_shipdate)-1)*1152921504606846976 + l_orderkey*32768 + l_linenumber*4096
   + (l_partkey*31 + CAST(floor(l_extendedprice*100+0.5) AS BIGINT) + CAST(l_quantity AS BIGINT)) % 4096 AS k FROM lineitem) GROUP BY 1,2""")

fragment("hbars", """
SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, k) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, k) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM (SELECT *, epoch_us(ts) % 86400000000 * 67108864 + event_id % 67108864 AS k FROM events) GROUP BY 1,2""")

fragment("pb", """
SELECT symbol, ts, open, high, low, close, volume, row_number() OVER w - 1 AS i,
  count(*) OVER (PARTITION BY symbol) AS n, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl,
  (high+low+close)/3 AS tp, lag((high+low+close)/3) OVER w AS ptp,
  CASE WHEN high<>low THEN ((close-low)-(high-close))/(high-low) END AS mfm
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")


def recursions(src: str, out: str) -> None:
    """Register `out` = `src`(symbol, ts, i, high, low, close, pc, ph, pl) with every recursive indicator."""
    fragment(f"{out}_x", f"""
SELECT symbol, i, close, high, low,
  CASE WHEN i>0 THEN greatest(high-low, abs(high-pc), abs(low-pc)) END AS tr,
  CASE WHEN i>0 AND high-ph > pl-low AND high-ph > 0 THEN high-ph ELSE 0.0 END AS up,
  CASE WHEN i>0 AND pl-low > high-ph AND pl-low > 0 THEN pl-low ELSE 0.0 END AS dn,
  CASE WHEN i>0 THEN greatest(close-pc, 0.0) ELSE 0.0 END AS gn,
  CASE WHEN i>0 THEN greatest(pc-close, 0.0) ELSE 0.0 END AS ls
FROM {src}""")
    fragment(f"{out}_s", f"""
SELECT symbol, avg(close) FILTER (i<=19) AS s20, avg(close) FILTER (i<=49) AS s50, avg(close) FILTER (i<=199) AS s200,
  avg(close) FILTER (i BETWEEN 14 AND 25) AS sf, avg(close) FILTER (i<=25) AS sl,
  avg(tr) FILTER (i BETWEEN 1 AND 14) AS sa14, avg(tr) FILTER (i BETWEEN 1 AND 10) AS sa10,
  sum(up) FILTER (i BETWEEN 1 AND 13) AS sup, sum(dn) FILTER (i BETWEEN 1 AND 13) AS sdn, sum(tr) FILTER (i BETWEEN 1 AND 13) AS str,
  avg(gn) FILTER (i BETWEEN 1 AND 14) AS sgn, avg(ls) FILTER (i BETWEEN 1 AND 14) AS sls
FROM {out}_x GROUP BY symbol""")

    def ema(c, x, last, k, seed):
        return f"CASE WHEN x.i<{last} THEN CAST(NULL AS DOUBLE) WHEN x.i={last} THEN s.{seed} ELSE r.{c} + CAST({k} AS DOUBLE)*(x.{x}-r.{c}) END AS {c}"

    def wil(c, x, n, seed):
        return f"CASE WHEN x.i<{n} THEN CAST(NULL AS DOUBLE) WHEN x.i={n} THEN s.{seed} ELSE ({n-1}*r.{c} + x.{x})/{n} END AS {c}"

    def tot(c, x, seed):
        return f"CASE WHEN x.i<13 THEN CAST(NULL AS DOUBLE) WHEN x.i=13 THEN s.{seed} ELSE r.{c} - r.{c}/14 + x.{x} END AS {c}"

    cols = ["e20", "e50", "e200", "ef", "el", "a14", "a10", "sp", "sm", "st", "ag", "al"]
    fragment(f"{out}_r1", f"""RECURSIVE
SELECT symbol, CAST(-1 AS BIGINT) AS i, {', '.join(f'CAST(NULL AS DOUBLE) AS {c}' for c in cols)} FROM {out}_s
UNION ALL
SELECT x.symbol, x.i, {ema('e20','close',19,2/21,'s20')}, {ema('e50','close',49,2/51,'s50')}, {ema('e200','close',199,2/201,'s200')},
 {ema('ef','close',25,2/13,'sf')}, {ema('el','close',25,2/27,'sl')}, {wil('a14','tr',14,'sa14')}, {wil('a10','tr',10,'sa10')},
 {tot('sp','up','sup')}, {tot('sm','dn','sdn')}, {tot('st','tr','str')}, {wil('ag','gn',14,'sgn')}, {wil('al','ls',14,'sls')}
FROM {out}_r1 r JOIN {out}_x x ON x.symbol=r.symbol AND x.i=r.i+1 JOIN {out}_s s ON s.symbol=x.symbol""")
    fragment(f"{out}_y", f"""
SELECT r.*, x.high, x.low, x.close, r.ef-r.el AS line,
  CASE WHEN r.i>=14 THEN CASE WHEN st>0 THEN 100*sp/st ELSE 0 END END AS pdi,
  CASE WHEN r.i>=14 THEN CASE WHEN st>0 THEN 100*sm/st ELSE 0 END END AS mdi,
  CASE WHEN r.i>=14 THEN CASE WHEN st>0 AND sp+sm>0 THEN 100*abs(sp-sm)/(sp+sm) ELSE 0 END END AS dx,
  CASE WHEN r.i>=14 THEN CASE WHEN ag+al>0 THEN 100*ag/(ag+al) ELSE 0 END END AS rsi
FROM {out}_r1 r JOIN {out}_x x USING (symbol, i)""")
    fragment(f"{out}_t", f"""
SELECT symbol, avg(line) FILTER (i BETWEEN 25 AND 33) AS ssig, avg(dx) FILTER (i BETWEEN 14 AND 27) AS sadx FROM {out}_y GROUP BY symbol""")
    fragment(f"{out}_r2", f"""RECURSIVE
SELECT symbol, CAST(-1 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS sig, CAST(NULL AS DOUBLE) AS adx,
  CAST(NULL AS DOUBLE) AS fu, CAST(NULL AS DOUBLE) AS fl, CAST(1 AS DOUBLE) AS dir, CAST(NULL AS DOUBLE) AS pcl FROM {out}_t
UNION ALL
SELECT symbol, i, sig, adx, nfu, nfl,
  CASE WHEN a14 IS NULL THEN dir WHEN dir<0 AND close>nfu THEN 1.0 WHEN dir>0 AND close<nfl THEN -1.0 ELSE dir END, close
FROM (SELECT y.symbol, y.i, y.close, y.a14, r.dir,
   CASE WHEN y.i<33 THEN NULL WHEN y.i=33 THEN t.ssig ELSE r.sig + CAST(0.2 AS DOUBLE)*(y.line-r.sig) END AS sig,
   CASE WHEN y.i<27 THEN NULL WHEN y.i=27 THEN t.sadx ELSE (13*r.adx + y.dx)/14 END AS adx,
   CASE WHEN y.a14 IS NULL THEN NULL WHEN r.fu IS NULL OR (y.high+y.low)/2+3*y.a14 < r.fu OR r.pcl > r.fu THEN (y.high+y.low)/2+3*y.a14 ELSE r.fu END AS nfu,
   CASE WHEN y.a14 IS NULL THEN NULL WHEN r.fl IS NULL OR (y.high+y.low)/2-3*y.a14 > r.fl OR r.pcl < r.fl THEN (y.high+y.low)/2-3*y.a14 ELSE r.fl END AS nfl
  FROM {out}_r2 r JOIN {out}_y y ON y.symbol=r.symbol AND y.i=r.i+1 JOIN {out}_t t ON t.symbol=y.symbol)""")
    fragment(out, f"""
SELECT y.symbol, y.i, y.e20, y.e50, y.e200,
  coalesce(y.e20 - lag(y.e20) OVER w, 0) AS sl20, coalesce(y.e50 - lag(y.e50) OVER w, 0) AS sl50, coalesce(y.e200 - lag(y.e200) OVER w, 0) AS sl200,
  CASE WHEN y.i>=33 THEN y.line END AS macd, r.sig AS macd_signal, y.line - r.sig AS hist, lag(y.line - r.sig) OVER w AS hist_prev,
  y.a14 AS atr14, y.a10 AS atr10, y.pdi, y.mdi, r.adx, y.rsi, r.dir AS st_seeded, CAST(1 AS DOUBLE) AS st,
  CASE WHEN y.i>=18 THEN CASE WHEN max(y.rsi) OVER w5 > min(y.rsi) OVER w5 THEN 100*(y.rsi-min(y.rsi) OVER w5)/(max(y.rsi) OVER w5-min(y.rsi) OVER w5) ELSE 0 END END AS stoch_rsi
FROM {out}_y y JOIN {out}_r2 r USING (symbol, i)
WINDOW w AS (PARTITION BY y.symbol ORDER BY y.i), w5 AS (PARTITION BY y.symbol ORDER BY y.i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")


recursions("pb", "ind")
