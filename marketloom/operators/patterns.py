"""Chart patterns of the newest bar per symbol."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import day, f1, nz
from . import indicators as I

c = F.col

# Name, direction, strength, explanation; list order breaks ties. {} is the measured value.
PATTERNS = [
    ("Bollinger Squeeze", "neutral", 0.7, "Bands compressed — a sharp move is imminent."),
    ("Bollinger Breakout (Upper)", "bearish", 0.6, "Price above upper band — overbought, watch for pullback."),
    ("Bollinger Breakdown (Lower)", "bullish", 0.6, "Price below lower band — oversold, bounce likely."),
    ("MACD Bullish Crossover", "bullish", 0.75, "MACD crossed above signal — momentum turning positive."),
    ("MACD Bearish Crossover", "bearish", 0.75, "MACD crossed below signal — momentum turning negative."),
    ("Golden Cross", "bullish", 0.9, "50-DMA crossed above 200-DMA — long-term bullish."),
    ("Death Cross", "bearish", 0.9, "50-DMA crossed below 200-DMA — long-term bearish."),
    ("RSI Overbought", "bearish", 0.65, "RSI at {} — overbought, risk of reversal."),
    ("RSI Oversold", "bullish", 0.65, "RSI at {} — oversold, bounce opportunity."),
    ("Volume Spike", None, 0.8, "Volume {}x above 20d avg — strong institutional interest."),
    ("Hammer", "bullish", 0.7, "Hammer — potential reversal from downtrend."),
    ("Shooting Star", "bearish", 0.7, "Shooting star — potential reversal from uptrend."),
    ("Doji", "neutral", 0.7, "Doji — indecision between buyers and sellers."),
    ("Engulfing Bull", "bullish", 0.7, "Bullish engulfing — strong buying pressure."),
    ("Morning Star", "bullish", 0.7, "Morning star — 3-candle bullish reversal."),
    ("Evening Star", "bearish", 0.7, "Evening star — 3-candle bearish reversal."),
    ("Three White Soldiers", "bullish", 0.7, "Three white soldiers — sustained 3-day buying."),
    ("Three Black Crows", "bearish", 0.7, "Three black crows — sustained 3-day selling."),
    ("Head and Shoulder", "bearish", 0.8, "Three peaks with higher middle — classic top reversal."),
    ("Inverse Head and Shoulder", "bullish", 0.8, "Three troughs with lower middle — classic bottom reversal."),
    ("Multiple Top", "bearish", 0.8, "Multiple highs at same level — strong resistance ceiling."),
    ("Multiple Bottom", "bullish", 0.8, "Multiple lows at same level — strong support floor."),
    ("Ascending Triangle", "bullish", 0.8, "Flat top with rising lows — likely upside breakout."),
    ("Descending Triangle", "bearish", 0.8, "Flat bottom with falling highs — likely downside breakdown."),
    ("Wedge Up", "bearish", 0.8, "Rising wedge — converging highs/lows tilting up, bearish reversal ahead."),
    ("Wedge Down", "bullish", 0.8, "Falling wedge — converging highs/lows tilting down, bullish reversal ahead."),
    ("Channel Up", "bullish", 0.8, "Upward price channel — trending within defined bull corridor."),
    ("Channel Down", "bearish", 0.8, "Downward price channel — trending within defined bear corridor."),
    ("Double Top", "bearish", 0.8, "Two peaks at same level — expect breakdown below neckline."),
    ("Double Bottom", "bullish", 0.8, "Two troughs at same level — expect breakout above neckline."),
]
RANK = {name: rank for rank, (name, *_) in enumerate(PATTERNS)}
PRIORITY = {name: k for k, (name, *_) in enumerate(sorted(PATTERNS, key=lambda p: -p[2]))}
_BEARISH_SPIKE = len(PATTERNS)      # the volume spike takes its direction from the bar


def _row(name: str, test: Column, fact: Column | None = None, at: Column | None = None, value: Column | None = None) -> Column:
    """A hit: its place by strength, which fact row it uses, when it happened and the value to tell."""
    told = F.lit(None).cast("string") if value is None else f1(value)
    return F.when(test, F.struct(F.lit(PRIORITY[name]).alias("priority"), (F.lit(RANK[name]) if fact is None else fact).alias("fact"),
                                 (F.unix_timestamp("ts") if at is None else at).alias("at"), told.alias("told")))


def _facts() -> Column:
    """Fact table as one constant array, folded by the optimizer."""
    rows = [{"name": n, "direction": w or "bullish", "explanation": t, "strength": s, "rank": r}
            for r, (n, w, s, t) in enumerate(PATTERNS)]
    rows.append({**rows[RANK["Volume Spike"]], "direction": "bearish"})
    return F.from_json(F.lit(json.dumps(rows)),
                       "array<struct<name:string,direction:string,explanation:string,strength:double,rank:int>>")



class _Group:
    """Window columns a pattern family needs, kernel outputs it needs, and its tests."""

    windows: dict[str, Column] = {}
    kernels: list[str] = []
    shallow = False         # True when the newest `depth` bars are all it looks at
    depth = 0

    def second(self) -> dict[str, Column]:
        return {}

    def rows(self) -> list[Column]:
        raise NotImplementedError


class Bollinger(_Group):
    def __init__(self, ind):
        bb = ind.bollinger()
        self.windows = {k: bb[k] for k in ("bb_upper", "bb_lower", "bb_width")}

    def finish(self, d):
        return I.newest_pct_rank(d, "bb_width")

    keep = ["bb_upper", "bb_lower", "bb_width_count", "bb_width_pct"]

    def rows(self):
        ready = c("bb_width_count") >= 20
        squeeze = ready & (c("bb_width_pct") < 0.2)
        return [_row("Bollinger Squeeze", squeeze),
                _row("Bollinger Breakout (Upper)", ready & ~squeeze & (c("close") > c("bb_upper"))),
                _row("Bollinger Breakdown (Lower)", ready & ~squeeze & (c("close") < c("bb_lower")))]


class MacdCross(_Group):
    kernels = ["macd_hist", "macd_hist_prev"]
    keep: list[str] = []

    def __init__(self, ind):
        pass

    def rows(self):
        now, before = c("macd_hist"), c("macd_hist_prev")
        return [_row("MACD Bullish Crossover", (before < 0) & (now > 0)),
                _row("MACD Bearish Crossover", (before > 0) & (now < 0))]


class AverageCross(_Group):
    def __init__(self, ind):
        self.windows = {"sma_gap": ind.sma(50) - ind.sma(200)}
        self.ind = ind

    def second(self):
        return {"sma_gap_prev": self.ind.lag("sma_gap")}

    keep = ["sma_gap", "sma_gap_prev"]

    def rows(self):
        return [_row("Golden Cross", (c("sma_gap_prev") < 0) & (c("sma_gap") > 0)),
                _row("Death Cross", (c("sma_gap_prev") > 0) & (c("sma_gap") < 0))]


class Rsi(_Group):
    kernels = ["rsi"]
    keep: list[str] = []

    def __init__(self, ind):
        pass

    def rows(self):
        return [_row("RSI Overbought", c("rsi") > 75, value=c("rsi")), _row("RSI Oversold", c("rsi") < 25, value=c("rsi"))]


class VolumeSpike(_Group):
    shallow = True
    depth = 21

    def __init__(self, ind):
        self.windows = {"vol_mean": ind.over(F.avg("volume"), 20)}

    keep = ["vol_mean", "prev_close"]

    def rows(self):
        fact = F.when(c("close") > c("prev_close"), RANK["Volume Spike"]).otherwise(_BEARISH_SPIKE)
        return [_row("Volume Spike", (c("vol_mean") > 0) & (c("volume") > 2.5 * c("vol_mean")), fact, value=c("volume") / F.nullif(c("vol_mean"), F.lit(0.0)))]


class Candles(_Group):
    """Eight public candlestick definitions; averages leave the current bar out."""

    shallow = True
    depth = 16          # averages of ten bars before a bar three back

    def __init__(self, ind, signed: bool = False):
        self.ind, self.signed = ind, signed
        o, h, l, cl = c("open"), c("high"), c("low"), c("close")
        past = lambda e, n: ind.part(F.avg(e).over(ind.w.rowsBetween(-n, -1)))
        self.windows = {
            "body": F.abs(cl - o), "upper": h - F.greatest(o, cl), "lower": F.least(o, cl) - l,
            "white": cl >= o, "avg_body": past(F.abs(cl - o), 10),
            "thin": 0.1 * past(h - l, 10), "near": 0.2 * past(h - l, 5), "far": 0.6 * past(h - l, 5)}

    _LAGS = {1: ["open", "close", "high", "low", "body", "upper", "lower", "white", "avg_body", "thin", "near", "far"],
             2: ["open", "close", "body", "upper", "lower", "white", "avg_body", "thin", "near", "far"], 3: ["high", "white"]}

    def second(self):
        return {f"{x}_{k}": self.ind.lag(x, k) for k, xs in self._LAGS.items() for x in xs}

    def third(self):
        def b(x, k):
            return c(f"{x}_{k}") if k else c(x)

        top = lambda k: F.greatest(b("open", k), b("close", k))      # noqa: E731
        bottom = lambda k: F.least(b("open", k), b("close", k))      # noqa: E731
        i = c("i")
        bull = (c("white") & ~b("white", 1)
                & (((c("close") >= b("open", 1)) & (c("open") < b("close", 1)))
                   | ((c("close") > b("open", 1)) & (c("open") <= b("close", 1)))))
        bear = (~c("white") & b("white", 1)
                & (((c("open") >= b("close", 1)) & (c("close") < b("open", 1)))
                   | ((c("open") > b("close", 1)) & (c("close") <= b("open", 1)))))
        star = ((b("body", 2) > b("avg_body", 2)) & (b("body", 1) <= b("avg_body", 1))
                & (c("body") > c("avg_body")) & (i >= 12))
        steps = [
            (b("upper", k) < b("thin", k)) & b("white", k) for k in (2, 1, 0)]
        for k in (1, 0):
            steps += [b("close", k) > b("close", k + 1), b("open", k) > b("open", k + 1),
                      b("open", k) <= b("close", k + 1) + b("near", k + 1),
                      b("body", k) > b("body", k + 1) - b("far", k + 1)]
        soldiers = (c("body") > c("avg_body")) & (i >= 12)
        for s in steps:
            soldiers = soldiers & s
        crows = b("white", 3) & (b("high", 3) > b("close", 2)) & (i >= 13)
        for k in (2, 1, 0):
            crows = crows & ~b("white", k) & (b("lower", k) < b("thin", k))
        for k in (1, 0):
            crows = (crows & (b("open", k) < b("open", k + 1)) & (b("open", k) > b("close", k + 1))
                     & (b("close", k) < b("close", k + 1)))
        small = (c("body") < c("avg_body")) & (i >= 11)
        out = {
            "k_hammer": small & (c("lower") > c("body")) & (c("upper") < c("thin"))
            & (bottom(0) <= b("low", 1) + b("near", 1)),
            "k_shooting": small & (c("upper") > c("body")) & (c("lower") < c("thin")) & (bottom(0) > top(1)),
            "k_doji": (c("body") <= c("thin")) & (i >= 10),
            "k_engulf": (bull if self.signed else (bull | bear)) & (i >= 2),
            "k_morning": star & ~b("white", 2) & (top(1) < bottom(2)) & c("white")
            & (c("close") > b("close", 2) + 0.3 * b("body", 2)),
            "k_evening": star & b("white", 2) & (bottom(1) > top(2)) & ~c("white")
            & (c("close") < b("close", 2) - 0.3 * b("body", 2)),
            "k_soldiers": soldiers, "k_crows": crows}
        return {k: nz(v, False) for k, v in out.items()}

    keep = ["k_hammer", "k_shooting", "k_doji", "k_engulf", "k_morning", "k_evening", "k_soldiers", "k_crows"]
    names = ["Hammer", "Shooting Star", "Doji", "Engulfing Bull", "Morning Star", "Evening Star",
             "Three White Soldiers", "Three Black Crows"]

    def rows(self):
        return [_row(n, c(k)) for n, k in zip(self.names, self.keep)]


class Structural(_Group):
    """Six shape detectors over three-bar extremes; newest hit of each in the last 20 bars."""

    shallow = True

    def __init__(self, ind, window: int = 20):
        self.ind, self.window = ind, window
        self.depth = window + 4        # the oldest bar of the window looks three bars back
        hi3, lo3 = ind.over(F.max("high"), 3), ind.over(F.min("low"), 3)
        self.windows = {
            "hi3": hi3, "lo3": lo3,
            "ch3": ind.over(F.max("close"), 3), "cl3": ind.over(F.min("close"), 3),
            "h_prev": ind.lag("high"), "h_next": ind.lead("high"),
            "l_prev": ind.lag("low"), "l_next": ind.lead("low"),
            "c_prev": c("prev_close"),
            "h_trend": F.signum(c("high") - ind.lag("high", 2)),
            "l_trend": F.signum(c("low") - ind.lag("low", 2))}

    def second(self):
        h, l, cl = c("high"), c("low"), c("close")
        hi, lo, hp, hn, lp, ln = (c(x) for x in ("hi3", "lo3", "h_prev", "h_next", "l_prev", "l_next"))
        dip = (h < hp) & (h < hn)
        bump = (l > lp) & (l > ln)
        wide = (hi >= hp) & (lo <= lp)
        tight = (hi <= hp) & (lo >= lp)
        up = (c("h_trend") == 1) & (c("l_trend") == 1)
        down = (c("h_trend") == -1) & (c("l_trend") == -1)
        band = (hi - lo) <= 0.1 * (hi + lo) / 2
        calm = ((hp - lp) <= 0.05 * (hp + lp) / 2) & ((hn - ln) <= 0.05 * (hn + ln) / 2)
        found = {   # the second label of a pair overrides the first
            "head": ("Head and Shoulder", (hi > hp) & (hi > hn) & dip,
                     "Inverse Head and Shoulder", (lo < lp) & (lo < ln) & bump),
            "multiple": ("Multiple Top", (hi >= hp) & (c("ch3") < c("c_prev")),
                         "Multiple Bottom", (lo <= lp) & (c("cl3") > c("c_prev"))),
            "triangle": ("Ascending Triangle", wide & (cl > c("c_prev")),
                         "Descending Triangle", wide & (cl < c("c_prev"))),
            "wedge": ("Wedge Up", wide & up, "Wedge Down", tight & down),
            "channel": ("Channel Up", wide & band & up, "Channel Down", tight & band & down),
            "double": ("Double Top", (hi >= hp) & (hi >= hn) & dip & calm,
                       "Double Bottom", (lo <= lp) & (lo <= ln) & bump & calm)}
        # one long per hit: time and side, so the newest hit is a plain maximum
        stamp = F.unix_timestamp("ts") * 2
        return {f"h_{k}": F.when(t2, stamp + 1).when(t1, stamp) for k, (_, t1, _, t2) in found.items()}

    def third(self):
        return {k: self.ind.tail(F.max, c("h" + k[1:]), self.window) for k in self.keep}

    keep = ["s_head", "s_multiple", "s_triangle", "s_wedge", "s_channel", "s_double"]
    labels = [PATTERNS[k][0] for k in range(18, 30)]

    def rows(self):
        return [_row(self.labels[2 * j + side], F.pmod(c(k), F.lit(2)) == side,
                     at=F.floor(c(k) / 2)) for j, k in enumerate(self.keep) for side in (0, 1)]


ALL = (Bollinger, MacdCross, AverageCross, Rsi, VolumeSpike, Candles, Structural)
POINTWISE = (Bollinger, MacdCross, AverageCross, Rsi, VolumeSpike, Candles)


def _windowed(d: DataFrame, ind: I.Ind, parts: list[_Group]) -> DataFrame:
    for step in ("windows", "second", "third"):
        cols: dict[str, Column] = {}
        for p in parts:
            got = getattr(p, step, {})
            cols.update(got() if callable(got) else got)
        d = ind.apply(d, cols)
    for p in parts:
        d = p.finish(d) if hasattr(p, "finish") else d
    return d


def latest_patterns(bars: DataFrame, groups=ALL, min_bars: int = 1, best: bool = False) -> DataFrame:
    """(symbol, ts, patterns) for the newest bar; one exchange, one optional Python pass.

    best=True keeps only the strongest pattern, the earlier detector winning a tie (T08)."""
    wide, close_up = I.Ind(), I.Ind()
    parts = [g(close_up if g.shallow else wide) for g in groups]
    deep = [p for p in parts if not p.shallow]
    near = [p for p in parts if p.shallow]
    d = _windowed(I.prepared(bars, total=True), wide, deep)
    kernel_cols = sorted({k for p in deep for k in p.kernels})
    if kernel_cols:
        d = I.kernels(d, kernel_cols, keep=["i", "n", "prev_close", *dict.fromkeys(k for p in deep for k in p.keep)])
    if near:
        # only the newest bars feed these, so the windows (and an exchange after a kernel) see few rows
        d = d.where(c("i") >= c("n") - max(p.depth for p in near))
        d = d.drop(*[x for x in d.columns if x.startswith("_w")])
        d = _windowed(I.clustered(d) if kernel_cols else d, close_up, near)
    d = d.where((c("i") == c("n") - 1) & (c("n") >= min_bars))
    rows = [r for p in parts for r in p.rows()]
    hits = F.array_compact(F.array(*rows))
    hits = F.array_compact(F.array(F.array_min(hits))) if best else hits
    hits = d.select("symbol", "ts", hits.alias("hits"), _facts().alias("facts"))
    def fact(h, k):
        text = F.element_at("facts", h["fact"] + 1)[k]
        return F.replace(text, F.lit("{}"), F.coalesce(h["told"], F.lit("{}"))) if k == "explanation" else text

    named = F.transform("hits", lambda h: F.struct(*[
        fact(h, k).alias(k) for k in ("name", "direction", "explanation", "strength")],
        day(F.timestamp_seconds(h["at"])).alias("date"), F.element_at("facts", h["fact"] + 1)["rank"].alias("rank")))
    return hits.select("symbol", "ts", named.alias("patterns"))


def pattern_rows(found: DataFrame) -> DataFrame:
    return found.select("symbol", F.explode("patterns").alias("p")).select("symbol", "p.*")
