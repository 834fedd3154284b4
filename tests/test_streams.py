"""Streams: several micro-batches equal the batch result; conditions fire once."""
import pandas as pd
from pyspark.sql import functions as F

from marketloom.operators import indicators as I, signals as S
from marketloom.streaming import streams as Z


def slices():
    return [F.col("ts") < "2020-03-01", (F.col("ts") >= "2020-03-01") & (F.col("ts") < "2020-07-15"), F.col("ts") >= "2020-07-15"]


def feed(spark, bars, files=1):
    d = bars.coalesce(1)
    return Z.follow(spark, Z.land(d, slices()), bars.schema, files_per_batch=files)


def test_indicators_equal_batch(spark, walk):
    bars, _ = walk
    w = ["ema50", "macd_hist", "adx", "stoch_rsi", "supertrend_seeded"]
    a = Z.run_available(Z.indicators(feed(spark, bars), w)).select("symbol", "ts", *w).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    b = I.kernels(I.clustered(bars), w).select("symbol", "ts", *w).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)


def test_sticky_equals_batch(spark, walk):
    bars, _ = walk
    d = Z.run_available(Z.sticky(feed(spark, bars)))
    d = d.select("symbol", "from_bar", F.timestamp_seconds(F.col("j") * 60).alias("ts"), F.col("close").alias("open"), "high", "low", "close", "volume")
    got = {(r.symbol, r.from_bar, r.regime) for r in S.regimes(I.clustered(d, ["symbol", "from_bar"]), ["symbol", "from_bar"]).collect()}
    want = {(r.symbol, r.from_bar, r.regime) for r in S.sticky_regimes(bars).collect()}
    assert got == want and len(got) == 10


def test_watch_fires_once_with_earliest(spark, walk):
    bars, pdf = walk
    r = feed(spark, bars).select(F.col("symbol").alias("ticker"), "ts", F.col("close").alias("price"), F.lit(None).cast("double").alias("pct_change"),
                                 F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("action"))
    w = spark.createDataFrame([("1", "A", "price", ">", 100.0, None, "d", True), ("2", "A", "price", ">", 100.0, None, "d", False), ("3", "B", "price", ">", 1e9, None, "d", True)],
                              "id string, ticker string, metric string, operator string, threshold_num double, threshold_str string, description string, active boolean")
    got = Z.run_available(Z.fire_once(r, w)).collect()
    a = pdf[(pdf["symbol"] == "A") & (pdf["close"] > 100)]
    assert [(x.id, pd.Timestamp(x.ts)) for x in got] == [("1", a["ts"].min())]


def test_dedup(spark, walk):
    bars, pdf = walk
    d = Z.run_available(Z.dedup(feed(spark, bars), "symbol", "ts", "900 days"))
    assert sorted(r.symbol for r in d.collect()) == sorted(pdf["symbol"].unique())


def test_late_bar_is_left_out(spark, walk):
    bars, _ = walk
    late = (F.col("ts") >= "2020-02-01") & (F.col("ts") < "2020-02-03")
    order = [(F.col("ts") < "2020-03-01") & ~late, late, F.col("ts") >= "2020-03-01"]
    stream = Z.follow(spark, Z.land(bars.coalesce(1), order), bars.schema, files_per_batch=1)
    got = Z.run_available(Z.indicators(stream, ["ema50"])).select("symbol", "ts", "ema50").toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    want = I.kernels(I.clustered(bars.where(~late)), ["ema50"]).select("symbol", "ts", "ema50").toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)


def test_a_table_is_followed_as_a_file_and_as_a_folder(spark, tmp_path):
    d = spark.range(40).selectExpr("id", "CAST(id % 3 AS STRING) AS name")
    d.repartition(4).write.parquet(f"{tmp_path}/parts.parquet")
    d.toPandas().to_parquet(f"{tmp_path}/one.parquet")
    for name in ("parts", "one"):
        got = Z.run_available(Z.follow(spark, str(tmp_path), d.schema, files_per_batch=2, only=f"{name}.parquet"))
        assert sorted(r.id for r in got.collect()) == list(range(40))
