"""Bars that come late by less than the allowed time give exactly the batch result; later ones are reported."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import indicators as I, signals as S
from marketloom.streaming import ordered as O, streams as Z, watching as W

WANTED = ["ema50", "macd_hist", "adx", "supertrend_seeded"]


def feed(spark, bars, slices, close=True):
    """The slices landed one after the other, each a batch of its own, and a closing row."""
    one = bars.coalesce(1)
    path = Z.land(one, slices)
    if close:
        O.closing(spark, bars.schema).write.mode("append").parquet(path)
    return Z.follow(spark, path, bars.schema, files_per_batch=1)


def frame(df, names):
    return df.select(*names).toPandas().sort_values(names[:2]).reset_index(drop=True)


def slices(late):
    """Three slices in time order but for some bars that come one slice late."""
    t = F.col("ts")
    return [(t < "2020-03-01") & ~late, ((t >= "2020-03-01") & (t < "2020-07-15")) | late, t >= "2020-07-15"]


def test_late_bars_within_the_allowed_time_change_nothing(spark, walk):
    bars, _ = walk
    late = F.col("ts").between("2020-02-20", "2020-02-24")
    out = Z.run_available(O.in_order(feed(spark, bars, slices(late)), O.Recursion(WANTED), "10 days"))
    names = ["symbol", "ts", "close", *WANTED]
    pd.testing.assert_frame_equal(frame(out.where("NOT late"), names), frame(I.kernels(I.clustered(bars), WANTED), names), rtol=1e-9)
    assert out.where("late").isEmpty()


def test_later_bars_go_to_the_side(spark, walk):
    bars, _ = walk
    late = F.col("ts").between("2020-02-01", "2020-02-02")
    t = F.col("ts")
    parts = [(t < "2020-03-01") & ~late, (t >= "2020-03-01") & (t < "2020-07-15"), (t >= "2020-07-15") | late]  # two batches late
    out = Z.run_available(O.in_order(feed(spark, bars, parts), O.Recursion(WANTED), "10 days"))
    names = ["symbol", "ts", "close"]
    pd.testing.assert_frame_equal(frame(out.where("late"), names), frame(bars.where(late & (F.col("symbol") != "G")), names))
    kept = bars.where(~late | (F.col("symbol") == "G"))  # two bars only: nothing of it had left before
    pd.testing.assert_frame_equal(frame(out.where("NOT late"), [*names, *WANTED]), frame(I.kernels(I.clustered(kept), WANTED), [*names, *WANTED]), rtol=1e-9)


def test_second_bar_of_a_time_goes_to_the_side(spark, walk):
    bars, _ = walk
    twice = bars.where("symbol = 'A'").union(bars.where("symbol = 'A' AND ts = '2020-02-01'").withColumn("close", F.lit(1.0)))
    out = Z.run_available(O.in_order(feed(spark, twice, [F.lit(True)]), O.Recursion(["ema20"]), "1 day"))
    assert out.where("NOT late").count() == 320 and out.where("late").count() == 1


def test_bars_wait_until_the_feed_closes(spark, walk):
    bars, _ = walk
    out = Z.run_available(O.in_order(feed(spark, bars.where("symbol = 'A'"), [F.lit(True)], close=False), O.Recursion(["ema20"]), "10 days"))
    assert 300 <= out.count() <= 311


def test_refresh_points_equal_batch(spark, walk):
    bars, _ = walk
    late = F.col("ts").between("2020-02-20", "2020-02-24")
    d = Z.run_available(O.in_order(feed(spark, bars, slices(late)), O.RefreshPoints(), "10 days")).where("NOT late")
    d = d.select("symbol", "from_bar", F.timestamp_seconds(F.col("j") * 60).alias("ts"), F.col("close").alias("open"), "high", "low", "close", "volume")
    got = {(r.symbol, r.from_bar, r.regime) for r in S.regimes(I.clustered(d, ["symbol", "from_bar"]), ["symbol", "from_bar"]).collect()}
    want = {(r.symbol, r.from_bar, r.regime) for r in S.sticky_regimes(bars).collect()}
    assert got == want and len(got) == 10


CONTROLS = "ticker string, ts timestamp, id string, command string, metric string, operator string, threshold_num double, threshold_str string, description string"
READINGS = "ticker string, ts timestamp, price double, pct_change double, score double, action string"


def follow(spark, rows, schema, path):
    """One batch for each list of rows."""
    for part in rows:
        spark.createDataFrame([(t, pd.Timestamp(at).to_pydatetime(), *rest) for t, at, *rest in part], schema).coalesce(1).write.mode("append").parquet(path)
    return Z.follow(spark, path, schema, files_per_batch=1)


def test_watches_come_and_go_while_the_stream_runs(spark, tmp_path):
    price = lambda i, at, lim, op=">", t="A", command="create": (t, at, i, command, "price", op, lim, None, "d" + i)
    read = lambda at, p, t="A", action=None: (t, at, p, None, None, action)
    controls = [[price("early", "2024-01-01", 10.0), price("gone", "2024-01-01", 10.0), price("other", "2024-01-01", 10.0, t="B")],
                [price("later", "2024-01-03", 10.0), price("gone", "2024-01-03", None, command="delete"), price("early", "2024-01-03", 99.0)],
                [("A", "2024-01-05", "act", "create", "action", "==", None, "buy", "x"), price("odd", "2024-01-05", 1.0, op="!=")]]
    readings = [[read("2024-01-02", 5.0)], [read("2024-01-04", 20.0), read("2024-01-03 12:00", 15.0)], [read("2024-01-06", 30.0, action="BUY"), read("2024-01-06", 1.0, t="B")]]
    a, b = follow(spark, controls, CONTROLS, str(tmp_path / "c")), follow(spark, readings, READINGS, str(tmp_path / "r"))
    path = str(tmp_path / "fired")
    got = {(r.id, str(r.ts), r.current_value) for r in W.follow_into(W.fired(a, b), path, str(tmp_path / "cp")).collect()}
    assert got == {("early", "2024-01-03 12:00:00", 15.0), ("later", "2024-01-03 12:00:00", 15.0), ("act", "2024-01-06 00:00:00", 30.0)}
    again = W.follow_into(W.fired(a, b), path, str(tmp_path / "cp2"))  # the whole feed replayed
    assert {(r.id, str(r.ts), r.current_value) for r in again.collect()} == got
    more = follow(spark, [[read("2024-01-07", 50.0)]], READINGS, str(tmp_path / "r"))
    assert W.follow_into(W.fired(a, more), path, str(tmp_path / "cp")).count() == 3  # fired watches do not fire again


@pytest.mark.parametrize("operator,want", [(">", [0, 1]), (">=", [1, 1]), ("<", [0, 0]), ("<=", [1, 0]), ("==", [1, 0]), ("!=", [0, 0])])
def test_conditions(operator, want):
    rows = pd.DataFrame({"price": [5.0, 6.0, None], "pct_change": [None] * 3, "score": [None] * 3, "action": ["Buy", None, None]})
    assert W.holds(("price", operator, 5.0, None), rows).tolist() == [*map(bool, want), False]
    assert not W.holds(("volume", operator, 5.0, None), rows).any()
    assert W.holds(("action", "==", None, "BUY"), rows).tolist() == [True, False, False]
