"""Kernels against plain loops written from the public definitions."""
import math

import numpy as np
import pandas as pd
import pytest

from marketloom.functions import kernels as K


def loops(high, low, close):
    n = len(close)
    nan = float("nan")

    def ema(x, k, first, last):
        out, e = [nan] * n, None
        for i in range(n):
            if i == last:
                e = sum(x[first:last + 1]) / (last - first + 1)
            elif i > last:
                e += k * (x[i] - e)
            out[i] = nan if e is None else e
        return out

    tr = [nan] + [max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])) for i in range(1, n)]

    def wilder(x, p, last):
        out, a = [nan] * n, None
        for i in range(n):
            if i == last:
                a = sum(x[last - p + 1:last + 1]) / p
            elif i > last:
                a = ((p - 1) * a + x[i]) / p
            out[i] = nan if a is None else a
        return out

    atr = wilder(tr, 14, 14)
    line = [a - b for a, b in zip(ema(close, 2 / 13, 14, 25), ema(close, 2 / 27, 0, 25))]
    sig, s = [nan] * n, None
    for i in range(n):
        if i == 33:
            s = sum(line[25:34]) / 9
        elif i > 33:
            s += 0.2 * (line[i] - s)
        sig[i] = nan if s is None else s
    gain = [0.0] + [max(close[i] - close[i - 1], 0) for i in range(1, n)]
    loss = [0.0] + [max(close[i - 1] - close[i], 0) for i in range(1, n)]
    g, l = wilder(gain, 14, 14), wilder(loss, 14, 14)
    rsi = [nan if i < 14 else (100 * g[i] / (g[i] + l[i]) if g[i] + l[i] else 0.0) for i in range(n)]
    up, dn, t = 0.0, 0.0, 0.0
    pdi, mdi, dx = [nan] * n, [nan] * n, [nan] * n
    for i in range(1, n):
        a, b = high[i] - high[i - 1], low[i - 1] - low[i]
        x, y = (a if a > b and a > 0 else 0.0), (b if b > a and b > 0 else 0.0)
        if i < 14:
            up, dn, t = up + x, dn + y, t + tr[i]
        else:
            up, dn, t = up - up / 14 + x, dn - dn / 14 + y, t - t / 14 + tr[i]
            pdi[i], mdi[i] = (100 * up / t, 100 * dn / t) if t else (0.0, 0.0)
            dx[i] = 100 * abs(pdi[i] - mdi[i]) / (pdi[i] + mdi[i]) if pdi[i] + mdi[i] else 0.0
    return {"ema20": ema(close, 2 / 21, 0, 19), "atr14": atr, "macd_signal": sig, "rsi": rsi,
            "plus_di": pdi, "minus_di": mdi, "adx": wilder(dx, 14, 27)}


def run(pdf, size):
    pieces = [pdf.iloc[k:k + size] for k in range(0, len(pdf), size)]
    return pd.concat(K.sorted_stream(["symbol"], K.OUTPUTS)(iter(pieces)))


def test_against_loops(walk):
    _, pdf = walk
    out = run(pdf, 10_000)
    for name, g in out.groupby("symbol"):
        want = loops(g["high"].tolist(), g["low"].tolist(), g["close"].tolist()) if len(g) > 40 else {}
        for col, values in want.items():
            np.testing.assert_allclose(g[col].to_numpy(), np.array(values), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=f"{name} {col}")


@pytest.mark.parametrize("size", [1, 7, 50, 333])
def test_batches_do_not_matter(walk, size):
    _, pdf = walk
    whole, cut = run(pdf, 10_000), run(pdf, size)
    for col in K.OUTPUTS:
        np.testing.assert_allclose(cut[col].to_numpy(), whole[col].to_numpy(), rtol=1e-10, atol=1e-12, equal_nan=True, err_msg=col)


def test_flat_prices(walk):
    _, pdf = walk
    out = run(pdf[pdf["symbol"] == "FLAT"], 10_000).iloc[-1]
    assert out["adx"] == 0 and out["rsi"] == 0 and out["stoch_rsi"] == 0 and out["atr14"] == 0
    assert abs(out["macd_hist"]) < 1e-12 and out["supertrend"] == 1


def test_seeded_supertrend_flips():
    n = 200
    close = np.concatenate([np.linspace(100, 200, 100), np.linspace(200, 60, 100)])
    pdf = pd.DataFrame({"symbol": "X", "high": close + 1, "low": close - 1, "close": close})
    out = run(pdf, 1000)
    assert out["supertrend_seeded"].iloc[90] == 1 and out["supertrend_seeded"].iloc[-1] == -1
    assert (out["supertrend"] == 1).all() and not math.isnan(out["supertrend_seeded"].iloc[0])
