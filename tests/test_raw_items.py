"""News payload columns with empty and missing parts, against the query's SQL."""
import duckdb

import __spark_entry__ as entry

TEXTS = ["", None, "  a\nb \n", "\n", " ", "x\u2028", "x \u2028", "y \x85", "\x0bz\x0b", "\u00a0w\u00a0", "a\r\nb\r\n", "plain text"]


def test_odd_rows_follow_the_sql(spark, tmp_path):
    rows = [(None if i < 0 else i, TEXTS[i % len(TEXTS)], [None, "", "src"][i // len(TEXTS) % 3], "en") for i in range(-3, 420)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(path)
    got = entry.queries()["raw_item_normalize"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(entry.oracle_sql()["raw_item_normalize"])
    names = [d[0] for d in want.description]
    order = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(map(tuple, got.select(*names).collect()), key=order) == sorted(want.fetchall(), key=order)
