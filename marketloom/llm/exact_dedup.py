"""Exact de-duplication as a stateful stream with disk-backed keyed state.

Texts are equal when their normalised forms (white space deleted) are. `arrivals` writes one small
record per row: SHA-256 digest of the normalised text, identifier, length and locator (file and
block of the row's content). A stream over these records keeps, for every digest and without
expiry, the number of rows and the record that stays, in RocksDB state under the checkpoint
folder; a run over new arrivals resumes from that state. The final state is read back as a table.
Copies meet as partial aggregates of each task, so a group of any size reaches its state key as one
row per task.

A digest seen more than once is a hit, and the full bytes of all its rows are compared: within a
group the least and the greatest normalised text must be the same. A bitmap of the hits of fixed size
tells each task which of its rows can be hits, so texts seen once are not moved. The groups that hold
at least a thousandth of all rows (a thousand groups at most) are spread over salts for it. Should two
different texts share a digest, that digest's rows are grouped again by their full text.

Null texts count as empty texts, and all empty texts are equal. The row with the most code points
stays, then the smallest doc_id (null last), then the earliest record; of repeated rows exactly one
is kept. Empty tables give empty results; columns other than doc_id and text are not read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, scratch, split_by, stored

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A group with this share of all rows is salted for the comparison of full texts; hence a thousand groups at most.
HOT_SHARE, SALTS = 1000, 64
#: Input of one micro-batch of the stream.
BATCH_BYTES = 64 << 30


def normalised():
    return F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), f"{SPACE}+", "")


def arrivals(docs: DataFrame, digest=None, *others) -> DataFrame:
    """One record per row: row (unique), doc_id, digest, n_points, locator. digest: a function of the normalised text."""
    digest = digest or (lambda text: F.sha2(text, 256))
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        digest(normalised()).alias("digest"), F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_points"),
        F.concat_ws("#", F.input_file_name(), F.input_file_block_start()).alias("locator"), *others)


def _best():
    """The record that stays is the greatest."""
    return F.max(F.struct("n_points", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("minus_id"), (-F.col("row")).alias("minus_row"), "locator")).alias("best")


def _keeper(best="best"):
    return [(-F.col(f"{best}.minus_id")).alias("keep_id"), (-F.col(f"{best}.minus_row")).alias("keep_row"), F.col(f"{best}.locator").alias("keep_locator")]


def state_of(spark: SparkSession, records: str, checkpoint: str, batch_bytes: int = BATCH_BYTES, files_per_batch: int | None = None) -> DataFrame:
    """Feeds the records below a folder into the keyed state and returns the state: digest, group_size and the keeper.

    Calling it again with the same checkpoint takes only records that are new.
    """
    schema = spark.read.parquet(records).schema
    session = spark.newSession()
    session.conf.set(STATE_STORE, ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")  # an idle store holds 4 MB of local disk
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "200")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    stream = session.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes)
    if files_per_batch:
        stream = session.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    groups = stream.parquet(records).groupBy("digest").agg(F.count("*").alias("group_size"), _best())
    (groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    state = session.read.format("statestore").load(checkpoint)
    counted, best = (state.schema["value"].dataType.names[i] for i in (0, 1))
    plain = state.select(F.col("key.digest").alias("digest"), F.col("value")[counted].alias("group_size"), F.col("value")[best].alias("best"))
    return plain.select("digest", "group_size", *_keeper())


def find_copies(docs: DataFrame, digest=None, files_per_batch: int | None = None) -> DataFrame:
    """One row per document: row, doc_id, keep_id, group_size, kept, digest, locator, keep_locator."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    folder, checkpoint = scratch(spark, "arrivals"), scratch(spark, "copies-state")
    arrivals(docs, digest).write.parquet(folder)
    records = spark.read.parquet(folder)
    groups = stored(state_of(spark, folder, checkpoint, files_per_batch=files_per_batch), "copies")
    broken = _differing(docs, groups, records.count(), digest)
    if broken is None:
        return _decided(records, groups, ["digest"])
    rows = arrivals(docs, digest, normalised().alias("whole"))
    clean = _decided(records.join(broken, "digest", "left_anti"), groups, ["digest"])
    apart = stored(rows.join(broken, "digest", "left_semi"), "collisions")
    again = apart.groupBy("digest", "whole").agg(F.count("*").alias("group_size"), _best()).select("digest", "whole", "group_size", *_keeper())
    return clean.unionByName(_decided(apart, again, ["digest", "whole"]))


def _decided(records: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    return (records.join(groups, keys)
            .select("row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest", "locator", "keep_locator"))


def _differing(docs: DataFrame, groups: DataFrame, n_rows: int, digest=None) -> DataFrame | None:
    """Digests of hits whose texts are not all the same bytes; None if there is no such digest."""
    digest = digest or (lambda text: F.sha2(text, 256))
    hits = groups.filter("group_size > 1").select("digest", "group_size")
    hot = hits.filter(F.col("group_size") * HOT_SHARE >= n_rows).select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = hits.filter(F.col("group_size") * HOT_SHARE < n_rows).select("digest", F.lit(0).alias("salt")).unionByName(hot)
    hot_digests = F.broadcast(hot.filter("salt = 0").select(F.col("digest").alias("hot_digest")))  # a thousand rows at most
    texts = docs.select("doc_id", normalised().alias("whole"))
    texts, _ = split_by(texts.withColumn("digest", digest(F.col("whole"))), hits, "digest")
    texts = texts.join(hot_digests, F.col("digest") == F.col("hot_digest"), "left")
    spread = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    texts = texts.select("digest", F.when(F.col("hot_digest").isNull(), 0).otherwise(spread).alias("salt"), "whole")
    # the same kind of join at every size
    ends = (texts.join(salted.hint("merge"), ["digest", "salt"]).groupBy("digest", "salt").agg(F.min("whole").alias("low"), F.max("whole").alias("high"))
            .groupBy("digest").agg((F.min("low") != F.max("high")).alias("differ")))
    broken = stored(ends.filter("differ").select("digest"), "broken")
    return None if broken.isEmpty() else broken


def drop_copies(docs: DataFrame, digest=None) -> DataFrame:
    """docs without the rows that are copies of another row; rows of digests seen once are not moved."""
    digest = digest or (lambda text: F.sha2(text, 256))
    found = stored(find_copies(docs, digest).select("doc_id", "digest", "kept"), "found")
    hits = stored(found.groupBy("digest").count().filter("count > 1").select("digest"), "hits")
    rows = docs.select("doc_id", digest(normalised()).alias("digest"), F.struct(*[docs[c] for c in docs.columns]).alias("copy_row"))
    maybe, alone = split_by(rows, hits, "digest")
    kept, _ = split_by(found.filter("kept").select("doc_id", "digest"), hits, "digest")
    kept = kept.withColumnsRenamed({"doc_id": "kept_id", "digest": "kept_digest"}).hint("merge")
    out = maybe.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")), "left_semi")
    if not found.groupBy("doc_id", "digest").count().filter("count > 1").isEmpty():
        longest = F.max_by("copy_row", F.char_length(F.coalesce(F.col("copy_row.text"), F.lit(""))))
        out = out.groupBy("doc_id", "digest").agg(longest.alias("copy_row"))
    return alone.select("copy_row.*").unionByName(out.select("copy_row.*"))
