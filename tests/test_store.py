"""The rewritten table: nothing is lost, nothing is doubled."""
import pytest
from pyspark.sql import functions as F

from marketloom.sources import store as B

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def bars(spark, symbols, value, n=3):
    one = spark.createDataFrame([(s,) for s in symbols], "symbol string").withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return one.select("symbol", F.timestamp_seconds(c := F.col("d") * 86400).alias("ts"), *[F.lit(float(value)).alias(x) for x in B.BAR[2:]])


def rows(df):
    return sorted((r.symbol, r.ts, r.close) for r in df.collect())


def files(path):
    import pathlib

    return len([p for p in pathlib.Path(path).rglob("part-*.parquet")])


def test_one_symbol_rewritten_leaves_the_others(spark, tmp_path):
    path, names = str(tmp_path / "bars"), [f"S{i}" for i in range(40)]
    B.write_bars(bars(spark, names, 1), path, 4)
    B.write_bars(bars(spark, ["S7"], 2, 5), path)
    want = rows(bars(spark, [n for n in names if n != "S7"], 1).union(bars(spark, ["S7"], 2, 5)))
    assert rows(B.read_bars(spark, path)) == want
    assert rows(B.read_bars(spark, path, ["S7", "S8", "none"])) == [r for r in want if r[0] in ("S7", "S8")]
    with pytest.raises(ValueError):
        B.write_bars(bars(spark, names, 1), path, 8)
    assert rows(B.read_bars(spark, path)) == want


def test_rebucket_rewrites_the_whole(spark, tmp_path):
    path, names = str(tmp_path / "bars"), [f"S{i}" for i in range(40)]
    B.write_bars(bars(spark, names, 1), path, 4)
    store = B.Store(spark, path)
    store.rebucket(8)
    assert store.listing().buckets == 8 and rows(store.read()) == rows(bars(spark, names, 1))
    store.write(bars(spark, ["S1"], 3))
    assert rows(store.read()) == rows(bars(spark, [n for n in names if n != "S1"], 1).union(bars(spark, ["S1"], 3)))


def test_replaced_files_are_removed_and_repeats_change_nothing(spark, tmp_path):
    path, names = str(tmp_path / "bars"), [f"S{i}" for i in range(40)]
    B.write_bars(bars(spark, names, 1), path, 4)
    before = files(path)
    for _ in range(3):
        B.write_bars(bars(spark, names, 1), path)
    assert files(path) == before and rows(B.read_bars(spark, path)) == rows(bars(spark, names, 1))


def test_uncommitted_generation_is_not_seen(spark, tmp_path):
    path, names = str(tmp_path / "bars"), ["A", "B"]
    B.write_bars(bars(spark, names, 1), path, 4)
    bars(spark, ["A"], 9).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{path}/data/1")  # a writer that died
    assert rows(B.read_bars(spark, path)) == rows(bars(spark, names, 1))
    B.write_bars(bars(spark, ["A"], 2), path)
    assert rows(B.read_bars(spark, path)) == rows(bars(spark, ["A"], 2).union(bars(spark, ["B"], 1)))


def test_state_is_upserted_deleted_and_emptied(spark, tmp_path):
    path = str(tmp_path / "state")
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, v string")
    read = lambda: {r.id: r.v for r in store.read().collect()}
    store = B.Store(spark, path)
    with pytest.raises(FileNotFoundError):
        store.read()
    B.save_state(frame({1: "a", 2: "b", None: "n"}), path, ["id"], 4)
    B.save_state(frame({2: "c", 3: "d", None: "n"}), path, ["id"])
    assert read() == {1: "a", 2: "c", 3: "d", None: "n"}
    store.insert(frame({3: "x", 4: "e"}))
    store.insert(frame({3: "x", 4: "e"}))
    assert read() == {1: "a", 2: "c", 3: "d", 4: "e", None: "n"}
    store.delete(frame({1: "", 3: "", 9: ""}))
    assert read() == {2: "c", 4: "e", None: "n"}
    B.save_state(frame({}), path, ["id"])
    store.delete(frame({2: "", 4: ""}))
    assert read() == {None: "n"}
    with pytest.raises(ValueError):
        B.save_state(frame({1: "a"}), path, ["v"])


def test_a_table_can_be_rewritten_from_itself(spark, tmp_path):
    path = str(tmp_path / "bars")
    B.write_bars(bars(spark, ["A", "B", "C"], 1), path, 2)
    B.write_bars(B.read_bars(spark, path).where("symbol = 'B'").withColumn("close", F.col("close") + 1), path)
    assert {(r[0], r[2]) for r in rows(B.read_bars(spark, path))} == {("A", 1.0), ("B", 2.0), ("C", 1.0)}


def test_first_write_of_nothing_makes_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    B.write_bars(bars(spark, ["A"], 1).limit(0), path, 2)
    assert B.read_bars(spark, path).count() == 0 and B.read_bars(spark, path, ["A"]).count() == 0
    B.write_bars(bars(spark, ["A"], 1), path)
    assert B.read_bars(spark, path).count() == 3
