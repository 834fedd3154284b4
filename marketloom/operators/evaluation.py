"""Strategy evaluation as windowed columns over the whole panel."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import day, nz, rnd
from . import indicators as I
from .signals import bar_score, component_panel

c = F.col
# Long-only rules of the strategy test.
ENTER, LEAVE, WARM_UP, COMMISSION, MIN_BARS = 0.40, -0.40, 40, 0.001, 80


def positions(bars: DataFrame, seeded_supertrend: bool = False) -> DataFrame:
    """Holding state of every bar. The state is the last buy/sell event before the bar, since
    buying while long and selling while flat change nothing; a signal trades at the next open."""
    d = component_panel(bars, seeded_supertrend).where(c("n") >= MIN_BARS)
    d = d.select("symbol", "ts", "i", "n", "open", "close", bar_score().alias("score"))
    d = I.clustered(d)
    w = I.by_time(order="i")
    score = F.when(c("i") < WARM_UP, 0.0).otherwise(nz(c("score")))
    event = F.when(c("i") == c("n") - 1, None).when(score >= ENTER, 1).when(score <= LEAVE, -1)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("event", event.cast("int"))
    d = d.withColumn("held", nz(F.last("event", True).over(before), -1) == 1)
    d = d.withColumn("was_held", F.coalesce(F.lag("held").over(w), F.lit(False)))
    return d.withColumns({"entry": c("held") & ~c("was_held"), "exit": ~c("held") & c("was_held")})


def trades(pos: DataFrame) -> DataFrame:
    """Entries paired with the next exit; an open trade closes at the last close."""
    every = Window.partitionBy("symbol").orderBy("i").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    d = pos.withColumns({"last_close": F.last("close").over(every), "last_ts": F.last("ts").over(every)})
    d = d.where(c("entry") | c("exit"))
    w = Window.partitionBy("symbol").orderBy("i")
    d = d.withColumns({"x_open": F.lead("open").over(w), "x_ts": F.lead("ts").over(w)}).where("entry")
    out = F.coalesce(c("x_open"), c("last_close"))
    ret = F.when(c("open") > 0, (out - c("open")) / c("open") * 100).otherwise(0.0)
    return d.select("symbol", c("i").alias("entry_bar"), day(c("ts")).alias("entry_date"),
                    day(F.coalesce("x_ts", "last_ts")).alias("exit_date"), rnd(ret, 2).alias("return_pct"),
                    rnd(c("open"), 2).alias("entry"), rnd(out, 2).alias("exit"))


def equity(pos: DataFrame) -> DataFrame:
    """Value of 100 invested, with commission per leg, as a running product of bar factors."""
    w = Window.partitionBy("symbol").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    keep = 1 - COMMISSION
    prev = F.lag("close").over(w)
    factor = (F.when(c("entry"), keep * c("close") / c("open"))
              .when(c("held"), c("close") / prev)
              .when(c("exit"), c("open") / prev * keep).otherwise(1.0))
    closing = F.when((c("i") == c("n") - 1) & c("held"), keep).otherwise(1.0)
    d = pos.withColumn("factor", factor * closing)
    bought = F.last(F.when(c("entry"), c("open")), True).over(upto)
    sold = F.when(c("exit"), c("open")).when((c("i") == c("n") - 1) & c("held"), c("close"))
    return d.withColumns({
        "value": F.product("factor").over(upto) * 100.0,
        "benchmark": c("close") / F.first("close").over(upto) * 100.0,
        "trade_pct": F.when(sold.isNotNull(), rnd((sold - bought) / bought * 100, 2))})


def sampled(panel: DataFrame, points: int = 200) -> DataFrame:
    """At most `points` evenly spaced bars per symbol, chosen by arithmetic on the bar number."""
    step = (c("n") - 1) / (F.least(c("n"), F.lit(points)) - 1).cast("double")
    k = F.floor(c("i") / step)
    hit = (F.floor(k * step) == c("i")) | (F.floor((k + 1) * step) == c("i"))
    return panel.where((c("n") <= points) | hit | (c("i") == c("n") - 1))


def metrics(curve: DataFrame) -> DataFrame:
    """One performance row per symbol (B06–B09). Closed trades sit on the bar that ends them, so
    the curve alone gives every figure in one pass."""
    w = Window.partitionBy("symbol").orderBy("i")
    peak = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = curve.withColumns({"peak": peak, "ret": c("value") / F.lag("value").over(w) - 1})
    newest = c("i") == c("n") - 1
    d = d.groupBy("symbol").agg(
        F.max("n").alias("n"), F.max(F.when(newest, c("value"))).alias("final"),
        F.max(F.when(newest, c("benchmark"))).alias("bench"),
        F.max((c("peak") - c("value")) / c("peak") * 100).alias("dd"),
        F.avg("ret").alias("mu"), F.stddev_pop("ret").alias("sd"),
        F.count("trade_pct").alias("num_trades"), F.avg((c("trade_pct") > 0).cast("double")).alias("wins"))
    cagr = F.when(c("final") > 0, (F.pow(c("final") / 100.0, F.lit(252.0) / c("n")) - 1) * 100).otherwise(0.0)
    return d.select(
        "symbol", rnd(c("final") - 100, 2).alias("total_return_pct"), rnd(cagr, 2).alias("cagr_pct"),
        rnd(nz(c("wins")) * 100, 1).alias("win_rate"), rnd(c("dd"), 2).alias("max_drawdown_pct"),
        rnd(F.when(c("sd") > 0, c("mu") / c("sd") * F.sqrt(F.lit(252.0))).otherwise(0.0), 2).alias("sharpe"),
        "num_trades", rnd(c("bench") - 100, 2).alias("benchmark_return_pct"))


def last_trades(trade_rows: DataFrame, k: int = 20) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(c("entry_bar").desc())
    return trade_rows.withColumn("_r", F.row_number().over(w)).where(c("_r") <= k).drop("_r")
