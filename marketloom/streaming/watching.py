"""Standing conditions whose watches arrive as a stream of their own.

Control rows (create, delete) and readings meet in one keyed state per ticker: a map from watch to its
condition, its time of validity and whether it has fired. A watch looks at readings from its creation up
to its deletion, fires once and stays known, so its identifier cannot be used again. Fired rows are
merged into a table by identifier, where a replayed batch changes nothing.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import Store
from .ordered import ROCKSDB

c = F.col
READING = {"price": "double", "pct_change": "double", "score": "double", "action": "string"}
CONTROL = {"id": "string", "command": "string", "metric": "string", "operator": "string", "threshold_num": "double", "threshold_str": "string", "description": "string"}
FIRED = "id string, ticker string, description string, ts timestamp, current_value double"
_WATCH = "metric string, operator string, threshold_num double, threshold_str string, description string, since bigint, until bigint, fired boolean"
_VALUE = {"price": "price", "pct_change": "pct_change", "ta_score": "score"}
FOREVER = (1 << 62)


def events(controls: DataFrame, readings: DataFrame) -> DataFrame:
    """One stream of both kinds of rows. controls: ticker, ts and CONTROL's columns; readings: ticker, ts and READING's columns."""
    none = lambda kinds: [F.lit(None).cast(t).alias(n) for n, t in kinds.items()]
    a = controls.select("ticker", "ts", *[c(n).cast(t).alias(n) for n, t in CONTROL.items()], *none(READING))
    b = readings.select("ticker", "ts", *none(CONTROL), *[c(n).cast(t).alias(n) for n, t in READING.items()])
    return a.unionByName(b)


def holds(watch: tuple, rows: pd.DataFrame) -> np.ndarray:
    """Which readings meet a watch: equal within a hundredth, actions without regard to case; unknown metrics and operators never."""
    metric, operator, number, text = watch[:4]
    if metric == "action":
        said = rows["action"].fillna("").str.upper()
        return ((operator == "==") & (said == (text or "").upper()) & (text is not None)).to_numpy()
    if metric not in _VALUE or number is None:
        return np.zeros(len(rows), bool)
    value = rows[_VALUE[metric]].to_numpy(dtype=float)
    with np.errstate(invalid="ignore"):
        return {">": value > number, "<": value < number, ">=": value >= number, "<=": value <= number,
                "==": np.abs(value - number) < 0.01}.get(operator, np.zeros(len(rows), bool))


class Watching(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.watches = handle.getMapState("watches", "id string", _WATCH)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        at = pdf["ts"].astype("datetime64[us]").astype("int64")
        control = pdf["command"].notna()
        known = {k[0]: tuple(v) for k, v in self.watches.iterator()}
        changed = set()
        for r, t in sorted(zip(pdf[control].to_dict("records"), at[control]), key=lambda x: x[1]):
            if r["command"] == "create" and r["id"] not in known:
                plain = [None if pd.isna(r[n]) else r[n] for n in ("metric", "operator", "threshold_num", "threshold_str", "description")]
                known[r["id"]] = (*plain, int(t), FOREVER, False)
            elif r["command"] == "delete" and r["id"] in known:
                w = known[r["id"]]
                known[r["id"]] = (*w[:6], min(w[6], int(t)), w[7])
            else:
                continue
            changed.add(r["id"])
        order = np.argsort(at[~control].to_numpy(), kind="stable")
        readings, times = pdf[~control].iloc[order], at[~control].to_numpy()[order]
        fired = []
        for name, w in known.items():
            if w[7] or not len(readings):
                continue
            hit = np.flatnonzero(holds(w, readings) & (times >= w[5]) & (times < w[6]))
            if len(hit):
                fired.append((name, key[0], w[4], readings["ts"].iloc[hit[0]], readings["price"].iloc[hit[0]]))
                known[name] = (*w[:7], True)
                changed.add(name)
        for name in changed:
            self.watches.updateValue((name,), known[name])
        if fired:
            yield pd.DataFrame(fired, columns=["id", "ticker", "description", "ts", "current_value"])

    def close(self) -> None:
        pass


cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["Watching"]))


def fired(controls: DataFrame, readings: DataFrame) -> DataFrame:
    """Rows of watches as they fire, from the two streams."""
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events(controls, readings).groupBy("ticker").transformWithStateInPandas(Watching(), FIRED, "append", "none")


def merge_into(path: str):
    """A sink for `foreachBatch`: rows of identifiers that the table does not hold yet are added."""
    def merge(batch: DataFrame, number: int) -> None:
        Store(batch.sparkSession, path).insert(batch, ["id"], 16)

    return merge


def follow_into(fired_rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs the stream over what its sources hold and returns the fired-event feed."""
    q = fired_rows.writeStream.foreachBatch(merge_into(path)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return Store(fired_rows.sparkSession, path).read()
