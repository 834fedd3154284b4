"""Composite scores, regimes and trade signals over a whole bar panel."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import clip, lookup, nz, rnd
from . import indicators as I

c = F.col

# Thresholds, weights and regime tables that results must match.
SIMPLE_BUY, SIMPLE_SELL = 1.5, -1.0
REGIME_THRESHOLD = {
    "UP": 1.3439356517951127,
    "DOWN": 3.1695083872890373,
    "RANGE": 4.143705431532906,
    "BREAKOUT": 2.4937810936812306,
    "SLEEPY": 0.5123198380380094,
    "CHOPPY": 1.3870943791432953,
    "WHALE": 1.7391220822447164,
}
# regime: (mean reversion, trend, momentum, large flow)
REGIME_WEIGHT = {
    "UP": (2.28, 0.61, 0.57, 1.99),
    "DOWN": (0.25, 1.80, 1.68, 0.60),
    "RANGE": (1.52, 0.11, 0.45, 1.46),
    "BREAKOUT": (2.33, 1.19, 2.44, 1.10),
    "SLEEPY": (1.62, 0.41, 1.35, 1.96),
    "CHOPPY": (0.90, 0.06, 0.63, 1.85),
    "WHALE": (0.65, 2.43, 2.18, 2.15),
}
REGIME_TEXT = {
    "UP": "Strong uptrend — SMA50 > SMA200, ADX > 25, +5% over 28d",
    "DOWN": "Strong downtrend — SMA50 < SMA200, ADX > 25, -5% over 28d",
    "RANGE": "Ranging market — moderate volatility, weak trend",
    "BREAKOUT": "Breakout — ATR expanding, price at 60-day high/low",
    "SLEEPY": "Low volatility sideways — ATR at lows",
    "CHOPPY": "Choppy/erratic — high daily swings, weak direction",
    "WHALE": "Institutional activity — volume spike + wide-range bar",
}
TREND_WEIGHT = {"adx": 1.2, "hist": 1.0, "di": 1.0, "slope20": 0.7, "slope50": 0.7,
                "slope200": 1.0, "band": 1.2}
VETO_BELOW, UPGRADE_FROM, SOCIAL_BOOST = -0.40, 0.35, 0.15

KERNELS = ["macd_hist", "atr14", "adx", "plus_di", "minus_di", "supertrend"]


EXTRA = {"sma50": lambda x: x.sma(50), "sma200": lambda x: x.sma(200), "prev_close": None}
TAILS = {"support": lambda x: x.tail(F.min, c("low"), 50), "resistance": lambda x: x.tail(F.max, c("high"), 50)}


# ── simple engine ───────────────────────────────────────────────────────────────────
def component_panel(bars: DataFrame, seeded_supertrend: bool = False, keep=()) -> DataFrame:
    """The four score components of every bar (C01–C04): one exchange, one Python pass."""
    ind = I.Ind()
    bb = ind.bollinger()
    cols = {k: bb[k] for k in ("bb_upper", "bb_lower")}
    cols.update({k: v(ind) for k, v in {**EXTRA, **TAILS}.items() if k in keep and v})
    base = ind.apply(I.prepared(bars, total=True), cols)
    kept = ["i", "n", "bb_upper", "bb_lower", *keep]
    trend = "supertrend_seeded" if seeded_supertrend else "supertrend"
    d = I.kernels(base, [k for k in KERNELS if k != "supertrend"] + [trend], keep=kept)
    strength = nz(clip((c("adx") - 15.0) / 25.0, 0.0, 1.0))
    offset = (c("close") - c("bb_lower")) / (c("bb_upper") - c("bb_lower")) - 0.5
    usable = (c("bb_upper") != c("bb_lower")) & (F.abs(offset) > 0.3)
    return d.withColumns({
        "macd_part": nz(clip(F.when(c("atr14") != 0, c("macd_hist") / c("atr14")), -1.0, 1.0)),
        "trend_part": c(trend),
        "adx_part": nz(F.signum(c("plus_di") - c("minus_di"))) * strength * 0.5,
        "band_part": F.when(usable, offset * -2.0).otherwise(0.0) * 0.5 * (1.0 - strength),
    })


PARTS = ["macd_part", "trend_part", "adx_part", "band_part"]


def bar_score() -> Column:
    return c("macd_part") + c("trend_part") + c("adx_part") + c("band_part")


def trend_state() -> Column:
    known = c("sma50").isNotNull() & c("sma200").isNotNull() & c("adx").isNotNull()
    return (F.when(~known, "NEUTRAL")
            .when((c("sma50") > c("sma200")) & (c("adx") > 20), "UPTREND")
            .when((c("sma50") < c("sma200")) & (c("adx") > 20), "DOWNTREND")
            .when(c("adx") < 15, "RANGING").otherwise("MIXED"))


TREND_TEXT = {
    "NEUTRAL": "Insufficient data for trend classification.",
    "UPTREND": "SMA50 > SMA200 with ADX > 20 — confirmed uptrend.",
    "DOWNTREND": "SMA50 < SMA200 with ADX > 20 — confirmed downtrend.",
    "RANGING": "ADX < 15 — low-trend, sideways market.",
    "MIXED": "Trend signals are mixed — no clear directional bias.",
}


def rising(gap: Column, base: float, room: float, k: float = 0.7) -> Column:
    """Confidence that starts at `base` % and approaches 100 % with the gap."""
    return (base + room * (1.0 - F.exp(-k * F.greatest(gap, F.lit(0.0))))) / 100.0


def pct_change(last: Column, prev: Column) -> Column:
    return F.when(prev > 0, rnd((last - prev) / prev * 100, 2))


def latest_components(bars: DataFrame, min_bars: int = 1, seeded_supertrend: bool = False) -> DataFrame:
    """Newest bar per symbol with rounded components; the flag rides through the kernel,
    so no second exchange is needed."""
    d = component_panel(bars, seeded_supertrend, keep=[*EXTRA, *TAILS])
    d = d.where((c("i") == c("n") - 1) & (c("n") >= min_bars))
    return d.withColumns({p: rnd(c(p), 4) for p in PARTS}).withColumn("score", bar_score())


def simple_signals(bars: DataFrame, seeded_supertrend: bool = False) -> DataFrame:
    """Signal record of the simple engine per symbol (C07); needs 60 bars."""
    d = latest_components(bars, 60, seeded_supertrend)
    action = (F.when(c("score") >= SIMPLE_BUY, "BUY").when(c("score") <= SIMPLE_SELL, "SELL")
              .otherwise("HOLD"))
    conf = (F.when(c("suggested_action") == "BUY", rising(c("score") - SIMPLE_BUY, 60.0, 40.0))
            .when(c("suggested_action") == "SELL", rising(-c("score"), 60.0, 40.0)).otherwise(0.5))
    return (d.withColumn("suggested_action", action).withColumn("regime", trend_state())
            .select(c("symbol").alias("ticker"), "ts", rnd(c("score"), 4).alias("score"), "regime",
                    lookup(c("regime"), TREND_TEXT).alias("regime_desc"),
                    F.lit(SIMPLE_BUY).alias("threshold"), "suggested_action",
                    rnd(conf, 4).alias("confidence"), c("close").alias("last_close"), "prev_close",
                    pct_change(c("close"), c("prev_close")).alias("pct_change"),
                    F.create_map(*[x for p in PARTS for x in (F.lit(p), c(p))]).alias("component_scores"),
                    rnd(c("support"), 2).alias("support"), rnd(c("resistance"), 2).alias("resistance")))


# ── regime engine ───────────────────────────────────────────────────────────────────
_NEEDS = {   # windows, then windows over those, then kernel outputs, per factor
    "meanrev": (["bb_mid", "bb_upper", "bb_lower", "sma20", "sma50", "sma200", "std5", "tp_mean"],
                ["prev_upper", "prev_lower", "tp_dev"], ["stoch_rsi"]),
    "trend": ([], [], ["macd_hist", "plus_di", "minus_di", "adx", "atr10", "slope20", "slope50", "slope200"]),
    "momentum": (["roc", "mom", "willr", "obv", "cmf"], ["obv4"], []),
    "whales": (["ad", "cmf", "obv", "vwap", "mfi"], ["ad1", "obv1"], ["macd", "macd_signal"]),
}


def factor_panel(bars: DataFrame, lookback: int | None = None, parts=tuple(_NEEDS)) -> DataFrame:
    """Windowed and recursive inputs of the asked factor scores, on the last `lookback` bars if given."""
    ind = I.Ind()
    base = I.with_tp_flow(I.prepared(bars, total=True, last=lookback), ind)
    first = {
        **{k: (lambda k=k: ind.bollinger()[k]) for k in ("bb_mid", "bb_upper", "bb_lower")},
        "sma20": lambda: ind.sma(20), "sma50": lambda: ind.sma(50), "sma200": lambda: ind.sma(200),
        "tp_mean": lambda: ind.tail(F.avg, c("tp"), 20), "std5": lambda: ind.std(5),
        "roc": ind.roc, "mom": ind.mom, "willr": ind.willr, "obv": ind.obv,
        "ad": ind.ad_line, "cmf": ind.cmf, "vwap": ind.vwap, "mfi": lambda: I.mfi(ind)}
    second = {
        "prev_upper": lambda: ind.lag("bb_upper"), "prev_lower": lambda: ind.lag("bb_lower"),
        "tp_dev": lambda: ind.tail(F.avg, F.abs(c("tp") - c("tp_mean")), 20),
        "obv1": lambda: ind.lag("obv"), "obv4": lambda: ind.lag("obv", 4), "ad1": lambda: ind.lag("ad")}
    want = [dict.fromkeys(x for p in parts for x in _NEEDS[p][k]) for k in range(3)]
    base = ind.apply(base, {k: first[k]() for k in want[0]})
    base = ind.apply(base, {k: second[k]() for k in want[1]})
    kept = list(dict.fromkeys(["i", "n", "tp", "prev_close", *want[0], *want[1]]))
    if not want[2]:
        return base.select("symbol", "ts", *I.OHLCV, *kept)
    return I.kernels(base, list(want[2]), keep=kept)


def vote(test: Column, up: Column, otherwise=-1.0) -> Column:
    """+1 / −1 by a condition, 0 while its input is not warmed up."""
    return F.when(test, F.when(up, 1.0).otherwise(otherwise)).otherwise(0.0)


def meanrev_score() -> Column:
    """Six counter-trend rules on the newest bar."""
    price, prev = c("close"), c("prev_close")
    stretch = (price - c("sma20")) / c("sma20")
    cci = (c("tp") - c("tp_mean")) / (0.015 * c("tp_dev"))
    rule = [
        F.when(c("stoch_rsi") > 0.8, -1.0).when(c("stoch_rsi") < 0.2, 1.0),
        F.when(c("tp_dev") > 0, F.when(cci > 100, -1.0).when(cci < -100, 1.0)),
        F.when(price <= c("bb_lower"), 1.0).when(price >= c("bb_upper"), -1.0),
        F.when((prev <= c("prev_lower")) & (price >= c("bb_mid")), 1.0)
        .when((prev >= c("prev_upper")) & (price <= c("bb_mid")), -1.0),
        F.when(c("std5") > 3.7, F.when(c("sma50") > c("sma200"), -1.0)
               .when(c("sma200").isNotNull(), 1.0)),
        F.when(stretch > 0.05, -1.0).when(stretch < -0.05, 1.0),
    ]
    total = sum((nz(r) for r in rule), F.lit(0.0))
    return F.when(c("n") >= 200, total).otherwise(0.0)


def momentum_score() -> Column:
    """Five momentum rules on the newest bar."""
    total = (nz(F.when(c("roc") > 2, 1.0).when(c("roc") < -2, -1.0))
             + vote(c("mom").isNotNull(), c("mom") > 0)
             + nz(F.when(c("willr") < -80, 1.0).when(c("willr") > -20, -1.0))
             + vote(c("obv4").isNotNull(), c("obv") > c("obv4"))
             + vote(c("cmf").isNotNull(), c("cmf") > 0))
    return F.when(c("n") >= 20, total).otherwise(0.0)


def flow_score() -> Column:
    """Six volume-flow rules on the newest bar (C11)."""
    total = (vote(c("ad1").isNotNull(), c("ad") > c("ad1"))
             + vote(c("cmf").isNotNull(), c("cmf") > 0)
             + vote(c("obv1").isNotNull(), c("obv") > c("obv1"))
             + vote(c("vwap").isNotNull(), c("close") > c("vwap"))
             + vote(c("macd_signal").isNotNull(), c("macd") > c("macd_signal"))
             + vote(c("mfi").isNotNull(), c("mfi") > 50))
    return F.when(c("n") >= 35, total).otherwise(0.0)


def factor_scores(bars: DataFrame, lookback: int | None = None, parts=tuple(_NEEDS)) -> DataFrame:
    """Mean-reversion, trend, momentum and flow scores per symbol.

    The trend score divides by full-history deviations, so one map-side-combined
    aggregate reduces every symbol to a row before anything moves. VWAP, OBV, A/D and the
    deviations depend on where the history starts; `lookback` cuts it to the newest bars."""
    d = factor_panel(bars, lookback, parts)
    newest = c("i") == c("n") - 1
    score = {"meanrev": meanrev_score, "momentum": momentum_score, "whales": flow_score}
    agg = [F.max("n").alias("n"), F.max(F.when(newest, c("close"))).alias("last_close"),
           F.max(F.when(newest, c("prev_close"))).alias("prev_close")]
    agg += [F.max(F.when(newest, f())).alias(k) for k, f in score.items() if k in parts]
    wide = ["hist", "di", "slope20", "slope50", "slope200"]
    if "trend" in parts:
        mid = (c("high") + c("low")) / 2
        band = (F.when(c("close") > mid + 3 * c("atr10"), 1.0)
                .when(c("close") < mid - 3 * c("atr10"), -1.0).otherwise(0.0))
        d = d.withColumns({"di": c("plus_di") - c("minus_di"), "hist": c("macd_hist"), "band": band})
        agg += [F.stddev_samp(x).alias(f"{x}_sd") for x in wide]
        agg += [F.max(F.when(newest, c(x))).alias(x) for x in [*wide, "adx", "band"]]
    g = d.groupBy("symbol").agg(*agg)
    if "trend" in parts:
        def z(x):
            sd = c(f"{x}_sd")
            return nz(F.when(sd > 0, c(x) / (sd + 1e-9)).otherwise(c(x)))

        part = {"adx": nz(c("adx") / 100.0), "band": c("band"), **{x: z(x) for x in wide}}
        total = sum((part[k] * w for k, w in TREND_WEIGHT.items()), F.lit(0.0)) / sum(TREND_WEIGHT.values())
        g = g.withColumn("trend", F.when(c("n") >= 200, total).otherwise(0.0))
    return g.select("symbol", "n", "last_close", "prev_close", *parts)


def regimes(sliced: DataFrame, keys: list[str], history: str = "slice28") -> DataFrame:
    """Regime of every 28-bar slice named by `keys`.

    `sliced` must be clustered by symbol and sorted by time. With history='slice28' the long
    averages never exist inside a slice, so UP, DOWN and BREAKOUT cannot occur; 'full' expects
    columns sma50, sma200, top60 and bottom60 computed on the whole history."""
    ind = I.Ind(keys)
    w = ind.w
    d = sliced.withColumns({"j": F.row_number().over(w) - 1, "chg": F.abs(c("close") / F.lag("close").over(w) - 1)})
    full = ["sma50", "sma200", "top60", "bottom60"] if history == "full" else []
    k = I.kernels(d, ["atr14", "adx"], keys=keys, keep=["j", "chg", *full])
    end = c("j") == 27

    def at_end(x):
        return F.max(F.when(end, x))

    g = k.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"), F.max(F.when(c("j") == 0, c("close"))).alias("first_close"),
        at_end(c("close")).alias("close"), at_end(c("high") - c("low")).alias("span"),
        at_end(c("volume")).alias("volume"), F.avg("volume").alias("mean_volume"),
        at_end(c("atr14")).alias("atr"), F.avg("atr14").alias("mean_atr"),
        F.percentile("atr14", 0.1).alias("atr_low"), at_end(c("adx")).alias("adx"),
        F.avg(F.when(c("j") >= 23, c("chg"))).alias("chop"),
        *[at_end(c(x)).alias(x) for x in full])
    move = (c("close") - c("first_close")) / c("first_close") * 100
    rule = F.when(c("bars") < 28, "RANGE").when(
        (c("volume") / c("mean_volume") > 3) & (c("span") > 2 * c("atr")), "WHALE")
    if history == "full":
        edge = (c("close") >= c("top60")) | (c("close") <= c("bottom60"))
        rule = (rule.when((c("atr") / c("mean_atr") > 1.5) & edge, "BREAKOUT")
                .when((c("sma50") > c("sma200")) & (move > 5) & (c("adx") > 25), "UP")
                .when((c("sma50") < c("sma200")) & (move < -5) & (c("adx") > 25), "DOWN"))
    rule = (rule.when((F.abs(move) < 3) & (c("adx") < 20),
                      F.when(c("atr") < c("atr_low"), "SLEEPY").otherwise("RANGE"))
            .when((c("adx") < 15) & (c("chop") > 0.02), "CHOPPY").otherwise("RANGE"))
    return g.select(*keys, rule.alias("regime"))


def latest_regime(bars: DataFrame, as_of=None, history: str = "slice28") -> DataFrame:
    """Regime of the last 28 bars per symbol, optionally as of a date."""
    src = bars if as_of is None else bars.where(c("ts") <= F.lit(as_of).cast("timestamp"))
    d = I.prepared(src, total=True)
    if history == "full":
        ind = I.Ind()
        d = ind.apply(d, {"sma50": ind.sma(50), "sma200": ind.sma(200),
                          "top60": ind.over(F.max("close"), 60), "bottom60": ind.over(F.min("close"), 60)})
    d = d.where(c("i") >= c("n") - 28)
    return regimes(d, ["symbol"], history)


def sticky_regimes(bars: DataFrame, first: int = 200, every: int = 28) -> DataFrame:
    """Regime at each refresh point (bar counts 200, 228, …) and the bars it is valid for."""
    d = I.indexed(I.clustered(bars))
    d = d.withColumn("block", F.floor((c("i") - (first - 28)) / F.lit(float(every))))
    d = d.where((c("i") >= first - 28) & (first - 28 + (c("block") + 1) * every <= c("n")))
    r = regimes(d, ["symbol", "block"])
    return r.select("symbol", (first - 1 + c("block") * every).alias("from_bar"),
                    (first - 1 + (c("block") + 1) * every - 1).alias("to_bar"), "regime")


def regime_confidence(score: Column, threshold: Column, action: Column) -> Column:
    return (F.when(action == "BUY", rising(score - threshold, 65.0, 35.0))
            .when(action == "SELL", rising(-score, 65.0, 35.0)).otherwise(0.5))


def linear_confidence(score: Column, threshold: Column, action: Column) -> Column:
    """Variant whose HOLD runs from 40 % to 65 % as the score nears the threshold."""
    return (F.when(action == "HOLD", clip((40.0 + 25.0 * (score / (threshold + 1e-6))) / 100.0, 0.0, 1.0))
            .otherwise(regime_confidence(score, threshold, action)))


def regime_scores(bars: DataFrame, history: str = "slice28") -> DataFrame:
    """Factor scores weighted by the symbol's regime (C14)."""
    f = factor_scores(bars).join(latest_regime(bars, history=history), "symbol")
    w = [lookup(c("regime"), {k: v[j] for k, v in REGIME_WEIGHT.items()}, 1.0) for j in range(4)]
    return f.withColumn("score", c("meanrev") * w[0] + c("trend") * w[1] + c("momentum") * w[2] + c("whales") * w[3])


def regime_signals(bars: DataFrame, confidence=regime_confidence, history: str = "slice28") -> DataFrame:
    """Signal record of the regime engine (C15); needs 200 bars."""
    d = regime_scores(bars, history).where(c("n") >= 200)
    d = d.withColumn("threshold", lookup(c("regime"), REGIME_THRESHOLD, 3.0))
    d = d.withColumn("suggested_action", F.when(c("score") >= c("threshold"), "BUY")
                     .when(c("score") <= 0, "SELL").otherwise("HOLD"))
    return d.select(
        c("symbol").alias("ticker"), "score", "regime", lookup(c("regime"), REGIME_TEXT, "").alias("regime_desc"),
        "threshold", "suggested_action",
        confidence(c("score"), c("threshold"), c("suggested_action")).alias("confidence"),
        "last_close", "prev_close", pct_change(c("last_close"), c("prev_close")).alias("pct_change"),
        "meanrev", "trend", "momentum", "whales")


# ── views on signals ────────────────────────────────────────────────────────────────
def five_level(score: Column) -> Column:
    return (F.when(score >= 2.0, "STRONG BUY").when(score >= 1.0, "WEAK BUY")
            .when(score <= -2.0, "STRONG SELL").when(score <= -1.0, "WEAK SELL").otherwise("HOLD"))


def with_conviction(signals: DataFrame) -> DataFrame:
    return (signals.withColumn("confidence", rnd(c("confidence"), 3))
            .withColumn("signal", five_level(c("score")))
            .withColumn("conviction", rnd(F.abs(c("score")) * c("confidence"), 4)))


def top_conviction(signals: DataFrame, k: int = 15) -> DataFrame:
    """Top-k report by conviction."""
    return with_conviction(signals).orderBy(c("conviction").desc(), c("ticker")).limit(k)


def bare_symbol(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit(".NS"), F.lit("")), F.lit(".BO"), F.lit(""))


def veto(signals: DataFrame, business: DataFrame, social: DataFrame) -> DataFrame:
    """Sentiment gate over a signal set (C18, C19): (ticker, sentiment) tables, missing → 0."""
    b = business.select(c("ticker").alias("_bt"), c("sentiment").alias("_b"))
    s = social.select(c("ticker").alias("_st"), c("sentiment").alias("_s"))
    d = (signals.withColumn("_k", bare_symbol(c("ticker")))
         .join(b, c("_k") == c("_bt"), "left").join(s, c("_k") == c("_st"), "left")
         .withColumn("business", nz(c("_b"))).withColumn("social", nz(c("_s"))))
    buy, hold = c("suggested_action") == "BUY", c("suggested_action") == "HOLD"
    blocked, lifted = buy & (c("business") <= VETO_BELOW), hold & (c("business") >= UPGRADE_FROM)
    return d.select(
        "ticker",
        F.when(buy, F.when(blocked, "Hold").otherwise("Buy")).when(hold, F.when(lifted, "Buy").otherwise("Hold"))
        .otherwise("Sell").alias("final_action"),
        (~blocked).alias("allow_buy"), F.lit(False).alias("force_sell"),
        F.when(blocked, F.format_string("Hard Business Veto (b=%.3f)", rnd(c("business"), 3)))
        .when(lifted, F.format_string("Business Positive Upgrade (b=%.3f)", rnd(c("business"), 3))).alias("reason"),
        c("score").alias("ta_score_original"), (c("score") + c("social") * SOCIAL_BOOST).alias("ta_score_boosted"),
        "business", "social",
        F.abs(c("score") / F.greatest(c("threshold"), F.lit(1e-6))).alias("confidence"))


PAYLOAD = ("ticker STRING, score DOUBLE, regime STRING, regime_desc STRING, threshold DOUBLE, "
           "suggested_action STRING, confidence DOUBLE, last_close DOUBLE, prev_close DOUBLE, "
           "support DOUBLE, resistance DOUBLE, error STRING")


def signals_from_payload(payload: DataFrame, column: str = "payload") -> DataFrame:
    """External signal documents (one object, a list, or a map per row) → signal rows."""
    body = F.trim(c(column))
    many = F.when(body.startswith("["), F.from_json(body, f"ARRAY<STRUCT<{PAYLOAD}>>"))
    one = F.from_json(body, PAYLOAD)
    by_key = F.map_values(F.from_json(body, f"MAP<STRING,STRUCT<{PAYLOAD}>>"))
    items = F.coalesce(many, F.when(one["ticker"].isNotNull(), F.array(one)), by_key)
    d = payload.select(F.explode(items).alias("d")).select("d.*")
    d = d.where(c("ticker").isNotNull() & (nz(c("error"), "") == ""))
    return d.select(
        "ticker", nz(c("score")).alias("score"), nz(c("regime"), "RANGE").alias("regime"),
        F.coalesce(F.nullif(c("regime_desc"), F.lit("")),
                   lookup(nz(c("regime"), "RANGE"), REGIME_TEXT, "")).alias("regime_desc"),
        nz(c("threshold"), 3.0).alias("threshold"),
        F.upper(F.coalesce(F.nullif(c("suggested_action"), F.lit("")), F.lit("HOLD"))).alias("suggested_action"),
        nz(c("confidence"), 0.5).alias("confidence"), nz(c("last_close")).alias("last_close"),
        "prev_close", "support", "resistance")
