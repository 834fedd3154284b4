"""Panel properties: layout independence, gates, evaluation against a bar loop."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marketloom.operators import evaluation as E, indicators as I, patterns as P, signals as S


def frame(df, keys):
    return df.toPandas().sort_values(keys).reset_index(drop=True)


def test_rows_partitions_and_other_symbols_do_not_matter(walk):
    bars, _ = walk
    a = frame(S.simple_signals(bars).drop("component_scores"), ["ticker"])
    b = frame(S.simple_signals(bars.orderBy(F.rand(3)).repartition(11)).drop("component_scores"), ["ticker"])
    pd.testing.assert_frame_equal(a, b)
    one = frame(S.simple_signals(bars.where("symbol = 'A'")).drop("component_scores"), ["ticker"])
    pd.testing.assert_frame_equal(a[a["ticker"] == "A"].reset_index(drop=True), one)


def test_gates(walk):
    bars, _ = walk
    assert {r.ticker for r in S.simple_signals(bars).collect()} == {"A", "B", "C", "D", "F", "FLAT"}
    assert {r.ticker for r in S.regime_signals(bars).collect()} == {"A", "B", "FLAT"}
    assert {r.symbol for r in E.positions(bars).select("symbol").distinct().collect()} == {"A", "B", "D", "FLAT"}
    short = {r.symbol: r.regime for r in S.latest_regime(bars).collect()}
    assert short["G"] == "RANGE" and len(short) == 8


def test_prefix_stability(walk):
    bars, _ = walk
    part = bars.where(F.col("ts") < "2020-08-01")
    cols = ["symbol", "ts", "macd_part", "adx_part", "band_part"]
    full = frame(S.component_panel(bars).where(F.col("ts") < "2020-08-01").select(*cols), ["symbol", "ts"])
    cut = frame(S.component_panel(part).select(*cols), ["symbol", "ts"])
    pd.testing.assert_frame_equal(full, cut, rtol=1e-9)


def test_sma_running_sum_equals_frame(walk):
    bars, pdf = walk
    ind = I.Ind()
    got = frame(ind.apply(I.prepared(bars), {"s": ind.sma(50)}).select("symbol", "ts", "s"), ["symbol", "ts"])
    want = pdf.groupby("symbol")["close"].transform(lambda x: x.rolling(50).mean())
    np.testing.assert_allclose(got["s"].to_numpy(), want.to_numpy(), rtol=1e-9, equal_nan=True)


def simulate(bars, score):
    cash, shares, entry, eq, trades = 100.0, 0.0, 0.0, [], []
    o, cl, n = bars["open"].to_numpy(), bars["close"].to_numpy(), len(bars)
    for i in range(n):
        eq.append(cash + shares * cl[i])
        if i == n - 1:
            break
        s = 0.0 if i < 40 or np.isnan(score[i]) else score[i]
        if shares == 0 and s >= 0.4:
            shares, entry, cash = cash * 0.999 / o[i + 1], o[i + 1], 0.0
        elif shares > 0 and s <= -0.4:
            cash = shares * o[i + 1] * 0.999
            trades.append((o[i + 1] - entry) / entry * 100)
            shares = 0.0
    if shares > 0:
        eq[-1] = shares * cl[-1] * 0.999
        trades.append((cl[-1] - entry) / entry * 100)
    return eq, trades


def test_evaluation_equals_bar_loop(walk):
    bars, pdf = walk
    panel = frame(S.component_panel(bars, seeded_supertrend=True).withColumn("score", S.bar_score())
                  .select("symbol", "ts", "open", "close", "score"), ["symbol", "ts"])
    pos = E.positions(bars, seeded_supertrend=True)
    curve = frame(E.equity(pos).select("symbol", "i", "value"), ["symbol", "i"])
    trades = frame(E.trades(pos), ["symbol", "entry_bar"])
    m = frame(E.metrics(E.equity(pos)), ["symbol"]).set_index("symbol")
    closed = 0
    for name in ("A", "B", "D"):
        g = panel[panel["symbol"] == name]
        eq, tr = simulate(g, g["score"].to_numpy())
        np.testing.assert_allclose(curve[curve["symbol"] == name]["value"], eq, rtol=1e-9)
        np.testing.assert_allclose(trades[trades["symbol"] == name]["return_pct"], tr, atol=0.0051)
        peak = np.maximum.accumulate(eq)
        assert abs(m.loc[name, "max_drawdown_pct"] - ((peak - eq) / peak * 100).max()) < 0.0051
        assert m.loc[name, "num_trades"] == len(tr)
        closed += len(tr)
    assert closed > 4


def test_sampling(walk):
    bars, _ = walk
    got = E.sampled(I.indexed(I.clustered(bars))).where("symbol = 'A'").select("i").toPandas()["i"].sort_values()
    assert got.tolist() == np.linspace(0, 319, 200, dtype=int).tolist()


def test_best_pattern_is_strongest_and_first(walk):
    bars, _ = walk
    every = P.pattern_rows(P.latest_patterns(bars)).toPandas()
    best = P.pattern_rows(P.latest_patterns(bars, best=True)).toPandas().set_index("symbol")
    for name, g in every.groupby("symbol"):
        top = g.sort_values(["strength", "rank"], ascending=[False, True]).iloc[0]
        assert best.loc[name, "name"] == top["name"]


def test_full_history_regimes(walk, spark):
    up = pd.DataFrame({"symbol": "U", "ts": pd.date_range("2020-01-01", periods=260), "close": np.linspace(50, 150, 260)})
    up["open"], up["high"], up["low"], up["volume"] = up["close"] - 0.1, up["close"] + 0.2, up["close"] - 0.2, 10.0
    bars = spark.createDataFrame(up)
    assert S.latest_regime(bars).first().regime == "RANGE"
    assert S.latest_regime(bars, history="full").first().regime == "UP"
