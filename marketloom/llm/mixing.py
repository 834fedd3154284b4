"""Mixing sources to target weights with exact word budgets.

Every document gets a hash-random key. Within a source the keys cut the unit interval into equal
ranges, about as many as the square root of the source's documents, so that neither a range nor
the table of range totals of a hot source is large. Prefix sums of sizes are the total of the
ranges before, plus a running sum within the range. A source's budget is met by whole passes over
the source (epochs) and then by its documents in key order up to the exact word, so the last
document may be taken in part.

Targets: sources in code point order, null last, weigh `weights`, repeating, and share `percent` of
all sizes; a target stops at `most` times its source's size and the excess is shared again by
weight. The fixed point has a closed form: sorted by size per weight, a first part of the sources
is at its ceiling and the others get the same amount per weight.

Null texts have size 0. Rows are never joined by identifier, so repeated rows are separate
documents. Documents of size 0 are never taken. An empty table gives an empty plan.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, same, small, stored, words_of

COLUMNS = ("size", "source_size", "target", "taken", "epochs", "part")


def targets(sized: DataFrame, weights=(3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """One row per source of (source, size): source_size, n_docs and target. The table of sources is small by nature."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*map(F.lit, weights))
    ranked = sources.withColumn("rank", F.row_number().over(order)).withColumn("weight", weight[(F.col("rank") - 1) % len(weights)])
    rising = Window.orderBy(F.col("source_size") * F.lit(most) / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(percent) / F.lit(100.0)
             - F.coalesce(F.sum("source_size").over(rising), F.lit(0)) * F.lit(most)) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0)))
    return (ranked.withColumn("level", level)
            .withColumn("target", F.least((F.col("source_size") * most).cast("double"), F.max("level").over(everything) * F.col("weight")))
            .select("source", F.col("rank").alias("source_rank"), "source_size", "n_docs", "target"))


def plan(sized: DataFrame, weights=(3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """Rows of sized (doc_id, source, size and any others) with source_size, target, epochs, part and taken.

    sized is read three times, so it should be a stored table or a cheap one.
    """
    budget = stored(targets(sized.select("source", "size"), weights, percent, most), "targets")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    unit = F.conv(F.substring("mix_key", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    own = small(budget)
    rows = (sized.join(own, same(sized, own, "source"), "left").drop(own["source"])
            .withColumn("mix_key", key)
            .withColumn("mix_range", F.floor(unit * F.ceil(F.sqrt(F.col("n_docs"))))))
    at = ["source_rank", "mix_range"]
    totals = rows.groupBy(at).agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source_rank").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*at, F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_before"))
    running = Window.partitionBy(*at).orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget_words = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget_words / F.col("source_size"))).otherwise(0).cast("long")
    left = budget_words - F.col("epochs") * F.col("source_size") - F.col("before")
    return (rows.join(offsets, at)
            .withColumn("before", F.col("range_before") + F.coalesce(F.sum("size").over(running), F.lit(0)))
            .withColumn("epochs", epochs)
            .withColumn("part", F.greatest(F.lit(0), F.least("size", left)).cast("long"))
            .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
            .drop("n_docs", "mix_key", "mix_range", "range_before", "before", "source_rank"))


def sizes(docs: DataFrame, *others: str) -> DataFrame:
    return docs.select("doc_id", "source", *others, words_of(F.col("text")).alias("size"))


def mix(docs: DataFrame, weights=(3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """The mixture itself: documents with their columns, repeated for each epoch, the last one cut after its budget."""
    names = docs.columns
    payload = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), F.struct(*[docs[c] for c in names]).alias("mix_row"))
    chosen = plan(payload, weights, percent, most).filter("taken > 0")
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("mix_row.text"), F.lit(f"{SPACE}*{WORD}"), F.lit(0)), 1, F.col("part").cast("int")), "")
    copies = F.array_repeat(F.col("mix_row.text"), F.col("epochs").cast("int"))
    cut = F.when(F.col("part") == 0, F.array().cast("array<string>")).when(F.col("part") == F.col("size"), F.array("mix_row.text")).otherwise(F.array(head))
    out = chosen.select("mix_row", F.explode(F.concat(copies, cut)).alias("mix_text"))
    fresh = {"text": F.col("mix_text"), "n_chars": F.char_length("mix_text").cast("long")}
    return out.select(*[fresh.get(c, F.col("mix_row")[c]).alias(c) for c in names])
