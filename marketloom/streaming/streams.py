"""Structured Streaming forms of the polling jobs.

Every job takes a streaming DataFrame and returns one; `run_available` drains a source once
into a table in the shared folder. Timestamps must be TIMESTAMP for watermarks.
"""
from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import kernels as _kernels
from ..functions.kernels import STATE, advance_rows, fresh_state
from ..session import shared_folder
from ..operators.watches import met
from ..sources.tables import time_order

cloudpickle.register_pickle_by_value(_kernels)
c = F.col


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain what the source holds, with checkpoint and output in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
         .option("path", f"{base}/out").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def land(df: DataFrame, slices: list[Column]) -> str:
    """Write rows slice by slice, oldest first, as a folder a file stream reads in that order."""
    path = f"{shared_folder(df.sparkSession)}/land-{uuid.uuid4().hex}"
    for s in slices:
        df.where(s).write.mode("append").parquet(path)
    return path


def follow(spark: SparkSession, path: str, schema, files_per_batch: int = 16, only: str | None = None) -> DataFrame:
    """Files of a folder as a stream, or those of the table named `only` in it, be it one file or a folder of them."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # a pattern, since a plain path must be a folder and a filter of names leaves out the files of a folder
    return r.parquet(f"{path}/{{{only}}}" if only else path)


def bars(ticks: DataFrame, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Bars of at most a day from (symbol, ts, price, qty, seq) ticks (X01); ticks of one time are ordered
    by seq, ticks later than `lateness` are dropped, a bar is emitted once its window can no longer change."""
    order = time_order(c("ts"), c("seq"))
    return (ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", width).alias("w"))
            .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", order).alias("close"), F.sum("qty").alias("volume"))
            .select("symbol", c("w.start").alias("ts"), "open", "high", "low", "close", "volume"))


def indicators(bar_stream: DataFrame, wanted: list[str]) -> DataFrame:
    """Recursive indicators per bar with carried state (X09): the batch kernel, resumed from a
    fixed vector of doubles per symbol, so nothing is recomputed. A bar that is not newer than
    the last one of its symbol comes too late for the recursion and is left out."""
    names = list(wanted)

    def step(key, batches, state):
        held, last = state.get if state.exists else (fresh_state(1)[:, 0], None)
        pdf = _in_time(batches, last)
        if not len(pdf):
            return
        flat, new = advance_rows(pdf, np.array([0]), np.array([len(pdf)]), np.array(held)[:, None].copy(), names)
        state.update((new[:, 0].tolist(), _newest(pdf)))
        yield pdf[["symbol", "ts", "close"]].assign(**flat)

    out = "symbol string, ts timestamp, close double, " + ", ".join(f"{w} double" for w in names)
    return (bar_stream.select("symbol", "ts", "high", "low", "close").groupBy("symbol")
            .applyInPandasWithState(step, out, "v array<double>, last bigint", "append", GroupStateTimeout.NoTimeout))


def _in_time(batches, last: int | None) -> pd.DataFrame:
    """The rows of one key in time order, without those that are not newer than the last one seen."""
    pdf = pd.concat(list(batches)).sort_values("ts")
    return pdf if last is None else pdf[pdf["ts"].astype("datetime64[us]").astype("int64") > last]


def _newest(pdf: pd.DataFrame) -> int:
    return int(pdf["ts"].astype("datetime64[us]").astype("int64").iloc[-1])


def sticky(bar_stream: DataFrame, first: int = 200, every: int = 28) -> DataFrame:
    """Regime refresh points as keyed state (X05): the last 28 bars and the bar count are kept;
    a 28-bar slice is emitted at bar counts 200, 228, … for the regime rules. Late bars are left out."""
    def step(key, batches, state):
        n, tail, last = state.get if state.exists else (0, [], None)
        pdf = _in_time(batches, last)
        if not len(pdf):
            return
        rows = [list(r) for r in tail] + pdf[["high", "low", "close", "volume"]].to_numpy().tolist()
        keep = len(rows) - len(pdf)
        stamps = pdf["ts"].tolist()
        for k in range(len(pdf)):
            count = n + k + 1
            if count >= first and (count - first) % every == 0:
                cut = rows[keep + k + 1 - every: keep + k + 1]
                if len(cut) == every:
                    yield pd.DataFrame({"symbol": key[0], "from_bar": count - 1, "at": stamps[k],
                                        "j": range(every), "high": [r[0] for r in cut], "low": [r[1] for r in cut],
                                        "close": [r[2] for r in cut], "volume": [r[3] for r in cut]})
        state.update((n + len(pdf), rows[-every:], _newest(pdf)))

    out = "symbol string, from_bar bigint, at timestamp, j bigint, high double, low double, close double, volume double"
    return (bar_stream.select("symbol", "ts", "high", "low", "close", "volume").groupBy("symbol")
            .applyInPandasWithState(step, out, "n bigint, tail array<array<double>>, last bigint", "append", GroupStateTimeout.NoTimeout))


def fire_once(readings: DataFrame, watches: DataFrame) -> DataFrame:
    """Standing conditions over a stream (X02, X04): the earliest reading that meets a watch
    fires it, and never again. Only readings that meet a watch reach the state."""
    hits = (readings.join(watches.where("active"), "ticker").where(met())
            .select("id", "ticker", "description", "ts", F.col("price").alias("current_value")))

    def step(key, batches, state):
        if state.exists:
            return
        first = None
        for pdf in batches:
            top = pdf.loc[[pdf["ts"].idxmin()]]
            if first is None or top["ts"].iloc[0] < first["ts"].iloc[0]:
                first = top
        if first is not None:
            state.update((True,))
            yield first[["id", "ticker", "description", "ts", "current_value"]]

    out = "id string, ticker string, description string, ts timestamp, current_value double"
    return hits.groupBy("id").applyInPandasWithState(step, out, "fired boolean", "append", GroupStateTimeout.NoTimeout)


def dedup(items: DataFrame, key: str, at: str, within: str) -> DataFrame:
    """First item per key while its watermark lasts."""
    return items.withWatermark(at, within).dropDuplicatesWithinWatermark([key])
