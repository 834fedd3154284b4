from llm.helpers import awkward, copies, empty
from marketloom.llm import exact_dedup
from marketloom.llm.common import scratch
from pyspark.sql import functions as F


def table(spark, n=300):
    rows = [(i, ["same text here", "same  text\there ", "other", None, "", "x y"][i % 6] if i < n // 2 else f"text {i % 70}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


def result(df):
    return {r.doc_id: (r.keep_id, r.group_size) for r in df.collect()}


def test_equals_plain_version(spark):
    rows, docs = table(spark)
    found = exact_dedup.find_copies(docs)
    assert result(found) == copies(rows)
    assert found.filter("kept").count() == len({k for k, _ in copies(rows).values()})


def test_micro_batches_and_resuming_give_the_same_state(spark):
    rows, docs = table(spark)
    assert result(exact_dedup.find_copies(docs, files_per_batch=1)) == copies(rows)
    folder, checkpoint = scratch(spark, "t"), scratch(spark, "t")
    exact_dedup.arrivals(docs.filter("doc_id < 100")).write.parquet(folder)
    first = exact_dedup.state_of(spark, folder, checkpoint)
    assert first.agg(F.sum("group_size")).first()[0] == 100
    exact_dedup.arrivals(docs.filter("doc_id >= 100")).write.mode("append").parquet(folder)
    state = {(r.keep_id, r.group_size) for r in exact_dedup.state_of(spark, folder, checkpoint).collect()}
    assert state == set(copies(rows).values())


def test_different_texts_with_one_digest_stay_apart(spark):
    rows, docs = table(spark)
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1)
    assert result(exact_dedup.find_copies(docs, weak)) == copies(rows)
    kept = {k for k, _ in copies(rows).values()}
    assert {r.doc_id for r in exact_dedup.drop_copies(docs, weak).collect()} == kept


def test_awkward_rows(spark):
    docs = awkward(spark)
    found = exact_dedup.find_copies(docs)
    assert found.count() == docs.count()
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.select("doc_id").collect()) == [0, 3, 4, 5, 7, 8, 9, 10]
    assert exact_dedup.find_copies(empty(spark)).count() == 0 and exact_dedup.drop_copies(empty(spark)).count() == 0


def test_clashing_columns_pass_through(spark):
    rows, docs = table(spark)
    names = ("copy_digest", "digest", "kept", "copy_row", "may", "row", "filter_bits")
    wide = docs.withColumns({n: F.lit(n) for n in names})
    kept = exact_dedup.drop_copies(wide)
    assert kept.columns == wide.columns and {tuple(r[n] for n in names) for r in kept.collect()} == {names}
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in copies(rows).values()}


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    from marketloom.llm import common

    rows, docs = table(spark)
    monkeypatch.setattr(common, "FILTER_BITS", 3)  # every row may be a hit
    assert result(exact_dedup.find_copies(docs)) == copies(rows)
    assert {r.doc_id for r in exact_dedup.drop_copies(docs).collect()} == {k for k, _ in copies(rows).values()}


def test_filter_never_loses_a_key(spark):
    from marketloom.llm.common import split_by

    keys, rows = spark.range(0, 40_000, 7), spark.range(40_000)
    maybe, none = split_by(rows, keys, "id")
    assert maybe.count() + none.count() == 40_000 and none.filter("id % 7 = 0").count() == 0
    assert maybe.count() < 5_800
    assert split_by(rows, keys.limit(0), "id")[0].count() == 0
