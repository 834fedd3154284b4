"""Standing conditions, result cache and run log."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import nz

c = F.col


def met() -> Column:
    """Does the reading meet the watch? Unknown metrics and operators never do; numeric
    equality means within one hundredth, action equality ignores case."""
    value = (F.when(c("metric") == "price", c("price")).when(c("metric") == "pct_change", c("pct_change"))
             .when(c("metric") == "ta_score", c("score")))
    t = c("threshold_num")
    op = (F.when(c("operator") == ">", value > t).when(c("operator") == "<", value < t)
          .when(c("operator") == ">=", value >= t).when(c("operator") == "<=", value <= t)
          .when(c("operator") == "==", F.abs(value - t) < 0.01).otherwise(False))
    action = (c("operator") == "==") & (F.upper(nz(c("action"), "")) == F.upper(c("threshold_str")))
    return nz(F.when(c("metric") == "action", action).otherwise(op), False)


def fire(readings: DataFrame, watches: DataFrame) -> DataFrame:
    """Earliest reading that meets each active watch (batch form of X02).
    readings: (ticker, ts, price, pct_change, score, action)."""
    d = readings.join(watches.where("active"), "ticker").where(met())
    return d.groupBy("id", "ticker", "description").agg(F.min("ts").alias("fired_at"))


def settle(watches: DataFrame, fired: DataFrame) -> DataFrame:
    """Watch table after a run: fired watches carry their time and become inactive."""
    d = watches.drop("fired_at").join(fired.select("id", "fired_at"), "id", "left")
    return d.withColumn("active", c("active") & c("fired_at").isNull())


def create(watches: DataFrame, new: DataFrame) -> DataFrame:
    """Watch table with new watches, described and active; an id that exists is left as it is."""
    fresh = described(new.join(watches.select("id"), "id", "left_anti")).withColumns({"active": F.lit(True), "fired_at": F.lit(None).cast("timestamp")})
    return watches.unionByName(fresh.select(*watches.columns))


def delete(watches: DataFrame, gone: DataFrame) -> DataFrame:
    return watches.join(gone.select("id"), "id", "left_anti")


def listing(watches: DataFrame) -> DataFrame:
    """Watches that can still fire, and those that have."""
    state = F.when(c("fired_at").isNotNull(), "fired").when(c("active"), "waiting").otherwise("paused")
    return watches.select("id", "ticker", "description", state.alias("state"), "fired_at")


def described(watches: DataFrame) -> DataFrame:
    """Default description for watches created without one."""
    text = F.concat_ws(" ", "ticker", "metric", "operator", F.coalesce(c("threshold_num").cast("string"), "threshold_str"))
    return watches.withColumn("description", F.coalesce(F.nullif(c("description"), F.lit("")), text))


def cache_split(asked: DataFrame, cached: DataFrame, now: Column, ttl_seconds: int = 120) -> DataFrame:
    """Requested symbols with the hit/miss decision of a time-limited result cache."""
    live = cached.where(F.unix_timestamp(now) - F.unix_timestamp("computed_at") < ttl_seconds)
    keys = live.groupBy("symbol").agg(F.max("computed_at").alias("computed_at"))
    return asked.join(keys, "symbol", "left").select("symbol", c("computed_at").isNotNull().alias("hit"))


def run_status(log: DataFrame) -> DataFrame:
    """Last state per job from an append-only run log."""
    last = F.max_by(F.struct("status", "started_at", "elapsed", "error"), F.struct("started_at", "run_id"))
    return log.groupBy("job").agg(last.alias("s"), F.count(F.lit(1)).alias("runs")).select("job", "runs", "s.*")
