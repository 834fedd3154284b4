"""Recursive indicator kernels, vectorised over many symbols and resumable bar by bar.

Rows arrive sorted by key and time.  Each Arrow batch is cut into key segments; segments
of similar length are laid side by side as a (bars, symbols) block so one numpy step
advances all of them.  What a recursion must remember is a fixed vector of doubles per
key (`STATE`), carried from batch to batch, so a key of any length needs constant memory
and the same code serves batch and streaming jobs.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

# name, input, first seed bar, last seed bar, decay, gain, seed scale
_LEVEL1 = [
    ("ema20", "close", 0, 19, 1 - 2 / 21, 2 / 21, 1 / 20),
    ("ema50", "close", 0, 49, 1 - 2 / 51, 2 / 51, 1 / 50),
    ("ema200", "close", 0, 199, 1 - 2 / 201, 2 / 201, 1 / 200),
    ("fast", "close", 14, 25, 1 - 2 / 13, 2 / 13, 1 / 12),
    ("slow", "close", 0, 25, 1 - 2 / 27, 2 / 27, 1 / 26),
    ("atr14", "tr", 1, 14, 13 / 14, 1 / 14, 1 / 14),
    ("atr10", "tr", 1, 10, 9 / 10, 1 / 10, 1 / 10),
    ("pdm", "up", 1, 13, 13 / 14, 1.0, 1.0),
    ("mdm", "dn", 1, 13, 13 / 14, 1.0, 1.0),
    ("trs", "tr", 1, 13, 13 / 14, 1.0, 1.0),
    ("gain", "gain", 1, 14, 13 / 14, 1 / 14, 1 / 14),
    ("loss", "loss", 1, 14, 13 / 14, 1 / 14, 1 / 14),
]
_LEVEL2 = [
    ("macd_signal", "macd", 25, 33, 1 - 2 / 10, 2 / 10, 1 / 9),
    ("adx", "dx", 14, 27, 13 / 14, 1 / 14, 1 / 14),
]
_P1 = {name: i for i, (name, *_) in enumerate(_LEVEL1)}

OUTPUTS = [
    "ema20", "ema50", "ema200", "slope20", "slope50", "slope200",
    "macd", "macd_signal", "macd_hist", "macd_hist_prev", "atr14", "atr10",
    "plus_di", "minus_di", "adx", "rsi", "stoch_rsi",
    "supertrend", "supertrend_seeded",
]

_N1, _N2 = len(_LEVEL1), len(_LEVEL2)
_IDX, _PC, _PH, _PL = 0, 1, 2, 3
_Y1 = slice(4, 4 + _N1)
_A1 = slice(_Y1.stop, _Y1.stop + _N1)
_Y2 = slice(_A1.stop, _A1.stop + _N2)
_A2 = slice(_Y2.stop, _Y2.stop + _N2)
_BAND = slice(_A2.stop, _A2.stop + 3)          # upper, lower, direction
_HIST = _BAND.stop
_RSI = slice(_HIST + 1, _HIST + 5)             # four RSI values before this bar
STATE = _RSI.stop


def fresh_state(symbols: int) -> np.ndarray:
    state = np.full((STATE, symbols), np.nan)
    state[_IDX] = 0.0
    state[_A1] = 0.0
    state[_A2] = 0.0
    state[_BAND.stop - 1] = 1.0
    return state


def _smooth(x, spec, pos, alive, y, acc):
    """Run `y = decay*y + gain*x` for a stack of quantities, each with its own seed window."""
    first = np.array([s[2] for s in spec])[None, :, None]
    last = np.array([s[3] for s in spec])[None, :, None]
    decay = np.array([s[4] for s in spec])[:, None]
    gain = np.array([s[5] for s in spec])[:, None]
    scale = np.array([s[6] for s in spec])[:, None]
    at = pos[:, None, :]
    live = alive[:, None, :]
    x = np.where(np.isfinite(x), x, 0.0)
    seed = np.where((at >= first) & (at <= last) & live, x, 0.0)
    start = (at == last) & live
    after = (at > last) & live
    out = np.empty_like(x)
    for t in range(x.shape[0]):
        acc = acc + seed[t]
        y = np.where(after[t], decay * y + gain * x[t], np.where(start[t], acc * scale, y))
        out[t] = y
    return np.where(at >= last, out, np.nan), y, acc


def _shift(x, first_row):
    return np.concatenate([first_row[None, :], x[:-1]], axis=0)


def _last(x, lengths):
    return x[lengths - 1, np.arange(x.shape[1])]


def advance(high, low, close, lengths, state, trend=True):
    """Advance a (bars, symbols) block; returns ({output: block}, new state)."""
    bars = close.shape[0]
    step = np.arange(bars)[:, None]
    alive = step < lengths[None, :]
    pos = state[_IDX][None, :] + step
    pc, ph, pl = (_shift(v, state[k]) for v, k in ((close, _PC), (high, _PH), (low, _PL)))
    tr = np.fmax(np.fmax(high - low, np.abs(high - pc)), np.abs(low - pc))
    rise, fall = high - ph, pl - low
    up = np.where((rise > fall) & (rise > 0), rise, 0.0)
    dn = np.where((fall > rise) & (fall > 0), fall, 0.0)
    move = close - pc
    inputs = {"close": close, "tr": tr, "up": up, "dn": dn,
              "gain": np.fmax(move, 0.0), "loss": np.fmax(-move, 0.0)}
    y1_before = state[_Y1]
    level1, y1, a1 = _smooth(np.stack([inputs[s[1]] for s in _LEVEL1], axis=1),
                             _LEVEL1, pos, alive, y1_before, state[_A1])
    q = {name: level1[:, i, :] for name, i in _P1.items()}
    warm_di = pos >= 14
    with np.errstate(divide="ignore", invalid="ignore"):
        plus = np.where(q["trs"] > 0, 100.0 * q["pdm"] / q["trs"], 0.0)
        minus = np.where(q["trs"] > 0, 100.0 * q["mdm"] / q["trs"], 0.0)
        dx = np.where(plus + minus > 0, 100.0 * np.abs(plus - minus) / (plus + minus), 0.0)
        swing = q["gain"] + q["loss"]
        rsi = np.where(swing > 0, 100.0 * q["gain"] / swing, 0.0)
    plus, minus = np.where(warm_di, plus, np.nan), np.where(warm_di, minus, np.nan)
    rsi = np.where(pos >= 14, rsi, np.nan)
    line = q["fast"] - q["slow"]
    level2, y2, a2 = _smooth(np.stack([line, dx], axis=1), _LEVEL2, pos, alive,
                             state[_Y2], state[_A2])
    signal, adx = level2[:, 0, :], level2[:, 1, :]
    line = np.where(pos >= 33, line, np.nan)
    hist = line - signal

    tail = np.concatenate([state[_RSI], rsi], axis=0)
    win = np.lib.stride_tricks.sliding_window_view(tail, 5, axis=0)
    top, bottom = win.max(axis=-1), win.min(axis=-1)
    spread = top - bottom
    with np.errstate(divide="ignore", invalid="ignore"):
        stoch = np.where(spread > 0, 100.0 * (rsi - bottom) / spread,
                         np.where(np.isnan(spread), np.nan, 0.0))

    seeded, band = np.ones_like(close), state[_BAND]
    if trend:
        seeded, band = _supertrend(high, low, close, pc, q["atr14"], alive, band)
    out = {
        "ema20": q["ema20"], "ema50": q["ema50"], "ema200": q["ema200"],
        "macd": line, "macd_signal": signal, "macd_hist": hist,
        "macd_hist_prev": _shift(hist, state[_HIST]),
        "atr14": q["atr14"], "atr10": q["atr10"],
        "plus_di": plus, "minus_di": minus, "adx": adx,
        "rsi": rsi, "stoch_rsi": stoch,
        # The published recursion compares with the undefined band of the bar before the
        # ATR exists, so its bands stay undefined and the direction never leaves +1.
        "supertrend": np.ones_like(close), "supertrend_seeded": seeded,
    }
    for n in ("20", "50", "200"):
        ema = q["ema" + n]
        before = _shift(ema, np.where(state[_IDX] > _LEVEL1[_P1["ema" + n]][3],
                                      y1_before[_P1["ema" + n]], np.nan))
        out["slope" + n] = np.nan_to_num(ema - before, nan=0.0)

    new = state.copy()
    new[_IDX] = state[_IDX] + lengths
    new[_PC], new[_PH], new[_PL] = _last(close, lengths), _last(high, lengths), _last(low, lengths)
    new[_Y1], new[_A1], new[_Y2], new[_A2], new[_BAND] = y1, a1, y2, a2, band
    new[_HIST] = _last(hist, lengths)
    new[_RSI] = np.stack([tail[lengths + k, np.arange(tail.shape[1])] for k in range(4)])
    return out, new


def _supertrend(high, low, close, pc, atr, alive, band, mult=3.0):
    """Band carry with direction flip, seeded by the first bar that has an ATR."""
    middle = (high + low) / 2.0
    top, bottom = middle + mult * atr, middle - mult * atr
    upper, lower, way = band
    out = np.empty_like(close)
    for t in range(close.shape[0]):
        ready = alive[t] & np.isfinite(atr[t])
        first = ready & np.isnan(upper)
        new_up = np.where((top[t] < upper) | (pc[t] > upper) | first, top[t], upper)
        new_lo = np.where((bottom[t] > lower) | (pc[t] < lower) | first, bottom[t], lower)
        flip_up = (way < 0) & (close[t] > new_up)
        flip_dn = (way > 0) & (close[t] < new_lo)
        way = np.where(ready, np.where(flip_up, 1.0, np.where(flip_dn, -1.0, way)), way)
        upper, lower = np.where(ready, new_up, upper), np.where(ready, new_lo, lower)
        out[t] = way
    return out, np.stack([upper, lower, way])


def _similar(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of segments whose lengths differ by at most about two, to bound padding."""
    order = np.argsort(lengths, kind="stable")
    begin = 0
    for end in range(1, len(order) + 1):
        if end == len(order) or lengths[order[end]] > 2 * lengths[order[begin]] + 16:
            yield order[begin:end]
            begin = end


def advance_rows(pdf: pd.DataFrame, starts: np.ndarray, lengths: np.ndarray,
                 state: np.ndarray, wanted: list[str]) -> tuple[dict, np.ndarray]:
    """Advance sorted rows cut at `starts`; returns flat output arrays and the states."""
    high, low, close = (pdf[c].to_numpy(dtype=float) for c in ("high", "low", "close"))
    flat = {name: np.empty(len(pdf)) for name in wanted}
    for group in _similar(lengths):
        size = lengths[group]
        step = np.arange(size.max())[:, None]
        take = np.minimum(starts[group][None, :] + step, len(pdf) - 1)
        keep = step < size[None, :]
        out, state[:, group] = advance(high[take], low[take], close[take], size, state[:, group],
                                       "supertrend_seeded" in wanted)
        for name in wanted:
            flat[name][take[keep]] = out[name][keep]
    return flat, state


def sorted_stream(keys: list[str], wanted: list[str]):
    """Function for `mapInPandas` over rows sorted by (keys, ts) within the partition."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, open_state = None, None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            change = np.zeros(len(pdf) - 1, dtype=bool)
            for k in keys:
                v = pdf[k].to_numpy()
                change |= v[1:] != v[:-1]
            starts = np.concatenate([[0], np.nonzero(change)[0] + 1])
            lengths = np.diff(np.concatenate([starts, [len(pdf)]]))
            state = fresh_state(len(starts))
            if open_key is not None and tuple(pdf[k].iloc[0] for k in keys) == open_key:
                state[:, 0] = open_state
            flat, state = advance_rows(pdf, starts, lengths, state, wanted)
            open_key = tuple(pdf[k].iloc[-1] for k in keys)
            open_state = state[:, -1].copy()
            yield pdf.assign(**flat)

    return run
