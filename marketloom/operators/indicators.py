"""Technical indicators over a whole bar panel (one exchange by key for all of them)."""
from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import kernels as _kernels
from ..functions.kernels import sorted_stream
from ..functions.numeric import nz

# Ship the kernels inside the task, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(_kernels)

OHLCV = ["open", "high", "low", "close", "volume"]


def by_time(keys=("symbol",), order: str = "ts"):
    return Window.partitionBy(*keys).orderBy(order)


def frame(n: int, keys=("symbol",)):
    return by_time(keys).rowsBetween(-(n - 1), 0)


def clustered(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    """Hash by key and sort by time once; windows and kernels reuse this layout."""
    return bars.repartition(*keys).sortWithinPartitions(*keys, "ts")


def kernels(bars: DataFrame, wanted: list[str], keys=("symbol",), keep=()) -> DataFrame:
    """Recursive indicators. `bars` must come from `clustered` (windows on top are fine)."""
    cols = list(dict.fromkeys([*keys, "ts", *OHLCV, *keep]))
    src = bars.select(*cols)
    schema = T.StructType(src.schema.fields + [T.StructField(w, T.DoubleType()) for w in wanted])
    return src.mapInPandas(sorted_stream(list(keys), list(wanted)), schema)


def indexed(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    """Bar number `i` from 0 and bars per key `n`."""
    return (bars.withColumn("i", F.row_number().over(by_time(keys)) - 1)
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))))


def last_n(bars: DataFrame, n: int, keys=("symbol",)) -> DataFrame:
    """Latest n bars of every key."""
    w = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    return bars.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def prepared(bars: DataFrame, keys=("symbol",), total: bool = False, last: int | None = None) -> DataFrame:
    """Clustered panel with bar number `i`, previous close and, if asked, bars per key `n`.

    `last` keeps the newest bars of every key and renumbers them, without another sort."""
    d = clustered(bars, keys)
    w = by_time(keys)
    d = d.withColumns({"i": F.row_number().over(w) - 1, "prev_close": F.lag("close").over(w)})
    if not (total or last):
        return d
    d = d.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    if last:
        d = d.where(F.col("i") >= F.col("n") - last).withColumns({
            "i": F.col("i") - F.greatest(F.col("n") - last, F.lit(0)), "n": F.least(F.col("n"), F.lit(last)),
            "prev_close": F.when(F.col("i") > F.greatest(F.col("n") - last, F.lit(0)), F.col("prev_close"))})
    return d


class Ind:
    """Windowed indicator columns over a `prepared` panel; NULL until the frame is full.

    Every window function an indicator needs becomes one shared column first (`part`), and
    the indicator is arithmetic over those columns, so no frame is evaluated twice."""

    def __init__(self, keys=("symbol",)):
        self.keys = keys
        self.w = by_time(keys)
        self.whole = Window.partitionBy(*keys)
        self.upto = self.w.rowsBetween(Window.unboundedPreceding, 0)
        self.i = F.col("i")
        self._parts: dict[str, tuple[str, Column]] = {}

    def part(self, expr: Column) -> Column:
        name, _ = self._parts.setdefault(str(expr), (f"_w{len(self._parts)}", expr))
        return F.col(name)

    def apply(self, d: DataFrame, cols: dict[str, Column]) -> DataFrame:
        """Add the pending window columns, then `cols` computed from them."""
        have = set(d.columns)
        new = {n: e for n, e in self._parts.values() if n not in have}
        d = d.withColumns(new) if new else d
        return d.withColumns(cols) if cols else d

    def rolling(self, agg: Column, n: int) -> Column:
        return self.part(agg.over(frame(n, self.keys)))

    def over(self, agg: Column, n: int, first: int | None = None) -> Column:
        return F.when(self.i >= (n - 1 if first is None else first), self.rolling(agg, n))

    def running(self, agg: Column) -> Column:
        return self.part(agg.over(self.upto))

    def lag(self, c, k: int = 1) -> Column:
        return self.part(F.lag(c, k).over(self.w))

    def lead(self, c, k: int = 1) -> Column:
        return self.part(F.lead(c, k).over(self.w))

    def tail(self, agg, expr: Column, n: int) -> Column:
        """Aggregate over the newest n bars, on every row of the key; needs columns i and n."""
        return self.part(agg(F.when(F.col("i") >= F.col("n") - n, expr)).over(self.whole))

    def sma(self, n: int) -> Column:
        """Short averages by sliding frame; long ones as a difference of two running sums,
        whose cost per bar does not grow with n."""
        if n < 50:
            return self.over(F.avg("close"), n)
        older = self.part(F.sum("close").over(self.w.rowsBetween(Window.unboundedPreceding, -n)))
        return F.when(self.i >= n - 1, (self.running(F.sum("close")) - nz(older)) / n)

    def true_range(self) -> Column:
        pc = F.col("prev_close")
        return F.when(pc.isNotNull(), F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))

    def bollinger(self, n: int = 20, k: float = 2.0) -> dict[str, Column]:
        mid, sd = self.sma(n), self.over(F.stddev_pop("close"), n)
        up, lo = mid + k * sd, mid - k * sd
        return {"bb_mid": mid, "bb_upper": up, "bb_lower": lo,
                "bb_pctb": F.when(up != lo, (F.col("close") - lo) / (up - lo)),
                "bb_width": (up - lo) / mid}

    def cci(self, n: int = 20) -> Column:
        tp = (F.col("high") + F.col("low") + F.col("close")) / 3
        xs, mean = self.rolling(F.collect_list(tp), n), self.rolling(F.avg(tp), n)
        dev = F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / n
        return F.when(self.i >= n - 1, F.coalesce((tp - mean) / (0.015 * F.nullif(dev, F.lit(0.0))), F.lit(0.0)))

    def roc(self, n: int = 10) -> Column:
        return 100 * (F.col("close") / self.lag("close", n) - 1)

    def mom(self, n: int = 10) -> Column:
        return F.col("close") - self.lag("close", n)

    def willr(self, n: int = 14) -> Column:
        hi, lo = self.over(F.max("high"), n), self.over(F.min("low"), n)
        return F.when(hi > lo, -100 * (hi - F.col("close")) / (hi - lo)).when(hi.isNotNull(), 0.0)

    def obv(self) -> Column:
        move = F.signum(F.col("close") - F.col("prev_close"))
        return self.running(F.sum(F.coalesce(move, F.lit(1.0)) * F.col("volume")))

    def flow_multiplier(self) -> Column:
        h, l, c = F.col("high"), F.col("low"), F.col("close")
        return F.when(h != l, ((c - l) - (h - c)) / (h - l))

    def ad_line(self) -> Column:
        return self.running(F.sum(nz(self.flow_multiplier()) * F.col("volume")))

    def cmf(self, n: int = 20) -> Column:
        mfv = self.flow_multiplier() * F.col("volume")
        full = self.rolling(F.count(mfv), n) == n
        return F.when(full, self.rolling(F.sum(mfv), n) / F.nullif(self.rolling(F.sum("volume"), n), F.lit(0.0)))

    def vwap(self) -> Column:
        tp = (F.col("high") + F.col("low") + F.col("close")) / 3
        return self.running(F.sum(tp * F.col("volume"))) / F.nullif(self.running(F.sum("volume")), F.lit(0.0))

    def vol_ratio(self, n: int = 20) -> Column:
        mean = self.over(F.avg("volume"), n)
        return F.when(mean > 0, F.col("volume") / mean)

    def std(self, n: int = 5) -> Column:
        return self.over(F.stddev_pop("close"), n)


def with_tp_flow(bars: DataFrame, ind: Ind) -> DataFrame:
    """Typical price and signed money flow, the inputs of MFI."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    d = bars.withColumn("tp", tp)
    d = ind.apply(d, {"_dtp": F.col("tp") - ind.lag("tp")})
    flow = F.col("tp") * F.col("volume")
    return d.withColumns({"mf_pos": F.when(F.col("_dtp") > 0, flow).otherwise(0.0),
                          "mf_neg": F.when(F.col("_dtp") < 0, flow).otherwise(0.0)})


def mfi(ind: Ind, n: int = 14) -> Column:
    """Money flow index over `with_tp_flow` columns; first value at bar n."""
    pos, neg = ind.rolling(F.sum("mf_pos"), n), ind.rolling(F.sum("mf_neg"), n)
    return F.when(ind.i >= n, F.when(pos + neg < 1, 0.0).otherwise(100 * pos / (pos + neg)))


def scaled(c: str, keys=("symbol",)) -> Column:
    """Series over its own full-history sample deviation, without centring."""
    sd = F.stddev_samp(c).over(Window.partitionBy(*keys))
    return F.when(sd > 0, F.col(c) / (sd + 1e-9)).otherwise(nz(F.col(c)))


def newest_pct_rank(d: DataFrame, x: str, keys=("symbol",)) -> DataFrame:
    """Percentile rank (ties averaged) of the newest value of `x` among the key's non-null ones,
    on every row as `<x>_pct` (I25): counts over the whole key, so no sort by value. Needs i, n."""
    whole = Window.partitionBy(*keys)
    d = d.withColumns({f"{x}_last": F.max(F.when(F.col("i") == F.col("n") - 1, F.col(x))).over(whole),
                       f"{x}_count": F.count(x).over(whole)})
    below = F.sum((F.col(x) < F.col(f"{x}_last")).cast("int")).over(whole)
    ties = F.sum((F.col(x) == F.col(f"{x}_last")).cast("int")).over(whole)
    d = d.withColumns({f"{x}_below": below, f"{x}_ties": ties})
    return d.withColumn(f"{x}_pct", (F.col(f"{x}_below") + (F.col(f"{x}_ties") + 1) / 2) / F.col(f"{x}_count"))
