"""Small helpers shared by the text operators."""
from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Characters that count as white space between words, and the words between them.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A small side is broadcast only when its values take at most this many bytes.
BROADCAST_BYTES = 8 << 20
#: Bits of the filter of `key_filter`: 8 MB, whatever the size of the tables.
FILTER_BITS = 1 << 26


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the folder that all executors share; removed when the driver ends."""
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
    except Exception:  # the session has ended before
        pass


#: Bytes of rows that pass to Python at once while a table is stored; texts and pairs of texts are long rows.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a shared table and read back: it is computed once and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that no later step reads."""
    for t in tables:
        _remove(t.sparkSession, t.scratch_path)


def release(spark: SparkSession) -> None:
    """Lets the driver drop the handles of finished steps, so that Spark removes their shuffle files."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its measured bytes are few; df is cheap to read (a stored table)."""
    width = sum([F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(16) for c, t in df.dtypes], F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else df


def key_filter(keys: DataFrame, *names: str) -> DataFrame:
    """A filter of the keys as one bitmap of `FILTER_BITS` bits: at most 2,049 rows of 4 KB, however many keys there are."""
    bit = _bit(names)
    return keys.groupBy(F.bitmap_bucket_number(bit).alias("filter_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("filter_bits"))


def _bit(names) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(FILTER_BITS))


def split_by(rows: DataFrame, keys: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the keys, rows that surely have none), told apart without moving a row.

    With very many keys the filter lets more rows pass as possible ones; both parts together are always all rows."""
    bit = _bit(names)
    marked = rows.withColumn("filter_bucket", F.bitmap_bucket_number(bit)).withColumn("filter_place", F.bitmap_bit_position(bit))
    marked = marked.join(F.broadcast(key_filter(keys, *names)), "filter_bucket", "left")
    byte = "CAST(conv(hex(substring(filter_bits, CAST(filter_place DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    marked = marked.withColumn("may", F.expr(f"coalesce((shiftright({byte}, CAST(filter_place % 8 AS INT)) & 1) = 1, false)"))
    marked = marked.drop("filter_bucket", "filter_place", "filter_bits")
    return marked.filter("may").drop("may"), marked.filter("NOT may").drop("may")


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of the named columns in which null equals null."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def words_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]
