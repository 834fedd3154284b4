"""Token sets of texts and their similarity."""
from pyspark.sql import functions as F

from marketloom.functions import scalars as X

TEXTS = ["A-b a  c9\n", "É ü x", "", None, "İ KK", "a b\x0bc", "---", "x y x"]


def test_tokens_are_those_of_the_normalised_text_found_in_one_pass(spark):
    d = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    old = F.array_distinct(F.filter(F.split(X.normalize_name(F.col("t")), " "), lambda x: x != ""))
    e = d.select(X.tokens(F.col("t")).alias("new"), old.alias("old"))
    assert all(r.new == r.old for r in e.collect())
    assert "regexp_replace" not in d.select(X.tokens(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_jaccard_of_token_sets(spark):
    d = spark.createDataFrame([("a b c", "b c d"), ("a", ""), ("x x", "x"), ("a", "b")], "a string, b string")
    e = d.select(X.jaccard(X.tokens(F.col("a")), X.tokens(F.col("b"))).alias("s"))
    assert [r.s for r in e.collect()] == [0.5, 0.0, 1.0, 0.0]
