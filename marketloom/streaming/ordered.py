"""Bars released in event-time order.

A bar waits in the list state of its symbol until the watermark has passed it; an event-time timer then
runs all bars that are due, oldest first, through a fold whose state has a fixed size. So a bar that is
late by less than the allowed time gives exactly the batch result, and a call holds one buffer, never a
symbol's history. A bar that is not newer than the last one released (or has the time of one that waits)
cannot take part any more; it leaves as a row marked `late`, which the sink keeps in a side table.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import kernels as _kernels
from ..functions.kernels import advance_rows, fresh_state

cloudpickle.register_pickle_by_value(_kernels)
c = F.col
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The time of a row without a symbol that lets every bar before it leave.
CLOSE = "2200-01-01"


class Recursion:
    """Recursive indicators per bar: the batch kernel resumed from a fixed vector of doubles."""

    state = "v array<double>"
    reads = ["high", "low", "close"]

    def __init__(self, wanted: list[str]):
        self.wanted = list(wanted)
        self.out = "symbol string, ts timestamp, close double, " + "".join(f"{w} double, " for w in wanted) + "late boolean"

    def fresh(self) -> tuple:
        return (fresh_state(1)[:, 0].tolist(),)

    def advance(self, symbol: str, held: tuple, bars: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        flat, new = advance_rows(bars, np.array([0]), np.array([len(bars)]), np.array(held[0])[:, None].copy(), self.wanted)
        return (new[:, 0].tolist(),), bars[["ts", "close"]].assign(symbol=symbol, late=False, **flat)

    def late(self, symbol: str, bars: pd.DataFrame) -> pd.DataFrame:
        return bars[["ts", "close"]].assign(symbol=symbol, late=True, **{w: np.nan for w in self.wanted})


class RefreshPoints:
    """The last `every` bars at bar counts first, first + every, …, for the regime rules."""

    state = "n bigint, tail array<array<double>>"
    reads = ["high", "low", "close", "volume"]
    out = "symbol string, from_bar bigint, at timestamp, j bigint, high double, low double, close double, volume double, late boolean"

    def __init__(self, first: int = 200, every: int = 28):
        self.first, self.every = first, every

    def fresh(self) -> tuple:
        return (0, [])

    def advance(self, symbol: str, held: tuple, bars: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        n, every = held[0], self.every
        rows = np.array([*map(list, held[1]), *bars[self.reads].to_numpy().tolist()], dtype=float).reshape(-1, len(self.reads))
        kept = len(rows) - len(bars)
        counts = n + 1 + np.arange(len(bars))
        due = np.flatnonzero((counts >= self.first) & ((counts - self.first) % every == 0) & (kept + np.arange(len(bars)) + 1 >= every))
        cuts = kept + due[:, None] + 1 - every + np.arange(every)
        out = pd.DataFrame(rows[cuts.ravel()], columns=self.reads).assign(
            symbol=symbol, from_bar=np.repeat(counts[due] - 1, every), at=np.repeat(bars["ts"].to_numpy()[due], every), j=np.tile(np.arange(every), len(due)), late=False)
        return (int(n + len(bars)), rows[-every:].tolist()), out

    def late(self, symbol: str, bars: pd.DataFrame) -> pd.DataFrame:
        return bars[self.reads].assign(symbol=symbol, from_bar=None, at=bars["ts"], j=None, late=True)


class InOrder(StatefulProcessor):
    """Holds bars until they are due and hands them to a fold in order."""

    def __init__(self, fold):
        self.fold = fold
        self.names = [x.strip().split()[0] for x in _fields(fold.out)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts bigint, " + ", ".join(f"{x} double" for x in self.fold.reads))
        self.held = handle.getValueState("held", "last bigint, " + self.fold.state)

    def _last(self) -> int | None:
        return self.held.get()[0] if self.held.exists() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:  # the closing row
            return
        last, known, soonest = self._last(), {r[0] for r in self.waiting.get()}, None
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[us]").astype("int64")
            late = at.duplicated() | at.isin(known)
            if last is not None:
                late |= at <= last
            if late.any():
                yield self.fold.late(key[0], pdf[late])[self.names]
            on_time = at[~late]
            if len(on_time):
                self.waiting.appendList([(int(t), *map(float, r)) for t, r in zip(on_time, pdf.loc[~late, self.fold.reads].to_numpy())])
                known.update(on_time)
                soonest = min(int(on_time.min()), soonest if soonest is not None else int(on_time.min()))
        if soonest is not None:
            self.handle.registerTimer(_ms(soonest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get())
        due = [r for r in waiting if r[0] <= until]
        if not due:
            return
        rest = waiting[len(due):]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(_ms(rest[0][0]))
        else:
            self.waiting.clear()
        bars = pd.DataFrame(due, columns=["ts", *self.fold.reads])
        bars["ts"] = pd.to_datetime(bars["ts"], unit="us")
        held = self.held.get()[1:] if self.held.exists() else self.fold.fresh()
        new, out = self.fold.advance(key[0], held, bars)
        self.held.update((due[-1][0], *new))
        yield out[self.names]

    def close(self) -> None:
        pass


def _ms(us: int) -> int:
    return -(-us // 1000)


def _fields(ddl: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(ddl[at:i])
            at = i + 1
    return [*parts, ddl[at:]]


cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["InOrder"]))


def in_order(bars: DataFrame, fold, lateness: str) -> DataFrame:
    """The fold's rows over a stream of bars (symbol, ts, …), each bar released once the watermark has passed it.

    The watermark is told by the time column; the fold gets a copy of it, as rows behind the watermark
    would otherwise be dropped before they could be reported."""
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = bars.select("symbol", c("ts").alias("event_time"), *fold.reads).withWatermark("event_time", lateness)
    rows = timed.select("symbol", F.timestamp_micros(F.unix_micros("event_time")).alias("ts"), *fold.reads)
    return rows.groupBy("symbol").transformWithStateInPandas(InOrder(fold), fold.out, "append", "eventTime")


def closing(spark: SparkSession, schema, at: str = CLOSE) -> DataFrame:
    """One row without a symbol; as the last one of a feed it lets all bars that still wait leave."""
    one = spark.range(1)
    fill = {f.name: F.lit(at).cast("timestamp") if f.name == "ts" else F.lit(None).cast(f.dataType) for f in schema.fields}
    return one.select(*[v.alias(k) for k, v in fill.items()])
