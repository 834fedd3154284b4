"""Bar store, state tables and graph snapshots.

`Store` is a Parquet table in hash buckets that is rewritten by merging. A write reads the buckets its
keys fall into, replaces the rows of these keys, and writes one new generation of those buckets; other
buckets are not touched. A generation counts once its list of buckets is committed, so a writer that
dies leaves the table as it was; the files of replaced generations are removed afterwards. The number
of buckets and the keys belong to the store, not to the call.
"""
from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from ..functions.numeric import day
from ..functions.scalars import market_open

c = F.col
BAR = ["symbol", "ts", "open", "high", "low", "close", "volume"]
BUCKETS = 64


@dataclass(frozen=True)
class Listing:
    """What a generation consists of: settings of the store and the generation that holds each bucket."""

    version: int
    keys: list[str]
    buckets: int
    schema: T.StructType
    parts: dict[int, int]


class Store:
    """A rewritable table below path. A store is created by its first write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ── listings ────────────────────────────────────────────────────────────────────
    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), target

    def _committed(self) -> list[int]:
        fs, folder = self._fs(f"{self.path}/listing")
        if not fs.exists(folder):
            return []
        names = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName()) for p in names if fs.exists(self._fs(f"{p}/_SUCCESS")[1]))

    def listing(self) -> Listing | None:
        versions = self._committed()
        if not versions:
            return None
        rows = self.spark.read.parquet(f"{self.path}/listing/{versions[-1]}").collect()  # one row per bucket at most
        first = rows[0]
        return Listing(versions[-1], list(first.keys), first.buckets, T.StructType.fromJson(json.loads(first.schema)), {r.bucket: r.generation for r in rows if r.bucket is not None})

    def _commit(self, new: Listing) -> None:
        text = json.dumps(new.schema.jsonValue())
        rows = [(b, g, new.keys, new.buckets, text) for b, g in sorted(new.parts.items())] or [(None, None, new.keys, new.buckets, text)]
        out = self.spark.createDataFrame(rows, "bucket int, generation long, keys array<string>, buckets int, schema string")
        out.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/listing/{new.version}")

    def _folder(self, generation: int, bucket: int) -> str:
        return f"{self.path}/data/{generation}/bucket={bucket}"

    def _remove(self, *paths: str) -> None:
        for p in paths:
            fs, target = self._fs(p)
            fs.delete(target, True)

    # ── reading ─────────────────────────────────────────────────────────────────────
    def _scan(self, now: Listing, buckets=None) -> DataFrame:
        paths = [self._folder(g, b) for b, g in sorted(now.parts.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(now.schema).parquet(*paths) if paths else self.spark.createDataFrame([], now.schema)

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The table, or the rows of some key values; only the buckets of these are read."""
        now = self.listing()
        if now is None:
            raise FileNotFoundError(f"no table at {self.path}")
        if keys is None:
            return self._scan(now)
        asked = keys.select(*now.keys).distinct()
        wanted = {r[0] for r in asked.select(_bucket(now.keys, now.buckets)).distinct().collect()}  # at most one row per bucket
        return self._scan(now, wanted).join(*_on(asked, now.keys), "left_semi")

    # ── writing ─────────────────────────────────────────────────────────────────────
    def write(self, rows: DataFrame, keys: list[str] | None = None, buckets: int | None = None) -> None:
        """Rows replace everything the table holds for their key values."""
        self._merge(rows, rows, keys, buckets)

    def insert(self, rows: DataFrame, keys: list[str] | None = None, buckets: int | None = None) -> None:
        """Rows of key values that the table does not hold yet; a repeated call changes nothing."""
        now = self.listing()
        if now is not None:
            rows = rows.join(*_on(self._scan(now), now.keys), "left_anti")
        self._merge(rows.dropDuplicates(keys or now.keys), rows, keys, buckets)

    def delete(self, keys: DataFrame) -> None:
        """All rows of some key values leave."""
        now = self.listing()
        if now is not None:
            self._merge(None, keys, None, None)

    def _merge(self, rows: DataFrame | None, changed: DataFrame, keys: list[str] | None, buckets: int | None) -> None:
        now = self.listing()
        if now is None:
            if not keys:
                raise ValueError("the first write names the keys")
            now = Listing(-1, list(keys), buckets or BUCKETS, rows.schema, {})
        if keys is not None and list(keys) != now.keys:
            raise ValueError(f"the table's keys are {now.keys}")
        if buckets is not None and buckets != now.buckets:
            raise ValueError(f"the table has {now.buckets} buckets; rebucket() changes them")
        mark = _bucket(now.keys, now.buckets)
        touched = {r[0] for r in changed.select(mark.alias("bucket")).distinct().collect()}  # at most one row per bucket
        if not touched:
            if now.version < 0:
                self._commit(Listing(0, now.keys, now.buckets, now.schema, {}))
            return
        held = self._scan(now, touched).join(*_on(changed.select(*now.keys).distinct(), now.keys), "left_anti")
        merged = held if rows is None else held.unionByName(rows.select(*now.schema.names))
        self._next(now, merged, touched)

    def rebucket(self, buckets: int) -> None:
        """The whole table rewritten with another number of buckets."""
        now = self.listing()
        self._next(Listing(now.version, now.keys, buckets, now.schema, now.parts), self._scan(now), set(now.parts) | set(range(buckets)))

    def _next(self, now: Listing, rows: DataFrame, touched: set[int]) -> None:
        """Writes one generation of the touched buckets, commits it and removes what it replaces."""
        version, folder = now.version + 1, f"{self.path}/data/{now.version + 1}"
        self._remove(folder)  # of a writer that never committed
        marked = rows.withColumn("bucket", _bucket(now.keys, now.buckets))
        (marked.hint("rebalance", "bucket").sortWithinPartitions("bucket", *now.keys, *[n for n in ("ts",) if n in now.schema.names])
         .write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder))
        fs, root = self._fs(folder)
        written = {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.isDirectory()}
        kept = {b: g for b, g in now.parts.items() if b not in touched}
        self._commit(Listing(version, now.keys, now.buckets, now.schema, kept | {b: version for b in written}))
        self._remove(*[self._folder(g, b) for b, g in now.parts.items() if b in touched], f"{self.path}/listing/{now.version}")
        gone = {g for g in now.parts.values()} - set(kept.values())
        self._remove(*[f"{self.path}/data/{g}" for g in gone if g != version])


def _on(other: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """The key columns of another table and the condition that they are equal, null to null."""
    renamed = other.select(*[c(k).alias(f"other_{k}") for k in keys])
    return renamed, reduce(lambda x, y: x & y, [c(k).eqNullSafe(c(f"other_{k}")) for k in keys])


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.hash(*keys), F.lit(buckets))


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """Scan of the bar store; with symbols only the buckets that hold them."""
    store = Store(spark, path)
    if symbols is None:
        return store.read()
    asked = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    return store.read(asked).select(*BAR)


def write_bars(bars: DataFrame, path: str, buckets: int | None = None) -> None:
    """Bars replace all bars the store holds of their symbols."""
    Store(bars.sparkSession, path).write(bars.select(*BAR), ["symbol"], buckets)


def normalize_bars(raw: DataFrame, symbol: str = "symbol", ts: str = "date") -> DataFrame:
    """Lower-case names, five price columns, missing volume 0, timestamps, no nulls."""
    d = raw.toDF(*[x.lower() for x in raw.columns])
    if "volume" not in d.columns:
        d = d.withColumn("volume", F.lit(0.0))
    d = d.select(c(symbol).alias("symbol"), F.try_to_timestamp(c(ts).cast("string")).alias("ts"),
                 *[c(x).cast("double").alias(x) for x in BAR[2:]])
    return d.na.drop("any")


def stale(coverage: DataFrame, now: Column, need: int = 300, open_hours: float = 6.0,
          closed_hours: float = 20.0) -> DataFrame:
    """Symbols to refresh: too old for the market state or too few bars.
    coverage: (symbol, bars, fetched_at)."""
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp("fetched_at")) / 3600.0
    ttl = F.when(market_open(now.cast("timestamp")), open_hours).otherwise(max(open_hours, closed_hours))
    return coverage.where((age > ttl) | (c("bars") < need))


def fresh_else_stored(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Fresh rows win bar by bar, stored rows fill the rest."""
    f, s = fresh.alias("f"), stored.alias("s")
    on = (c("f.symbol") == c("s.symbol")) & (c("f.ts") == c("s.ts"))
    have = c("f.symbol").isNotNull()
    return f.join(s, on, "full_outer").select(
        *[F.coalesce(f"f.{x}", f"s.{x}").alias(x) if x in ("symbol", "ts")
          else F.when(have, c(f"f.{x}")).otherwise(c(f"s.{x}")).alias(x) for x in BAR],
        F.when(have, "fresh").otherwise("stored").alias("origin"))


def latest_and_previous(bars: DataFrame) -> DataFrame:
    """Newest and previous close per symbol, NULL change below two bars."""
    w = Window.partitionBy("symbol").orderBy(c("ts").desc())
    d = bars.withColumn("_r", F.row_number().over(w)).where(c("_r") <= 2)
    d = d.groupBy("symbol").agg(F.max(F.when(c("_r") == 1, c("close"))).alias("last"),
                                F.max(F.when(c("_r") == 2, c("close"))).alias("prev"))
    return d.withColumn("price", F.when(c("prev").isNotNull(), c("last")))


def price_history(bars: DataFrame, n: int = 200) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(c("ts").desc())
    d = bars.withColumn("_r", F.row_number().over(w)).where(c("_r") <= n)
    return d.select("symbol", day(c("ts")).alias("date"), *BAR[2:])


def keep_last(rows: DataFrame, order: list[Column], n: int = 50) -> DataFrame:
    """Bounded log: the newest n rows (a top-k, so no full sort)."""
    return rows.orderBy(*order).limit(n)


def upsert(state: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """State table with changed rows replaced by key, as a plan; `save_state` persists it."""
    return state.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def save_state(changes: DataFrame, path: str, keys: list[str], buckets: int | None = None) -> None:
    """Changed rows replace those of their keys in the persisted state table."""
    Store(changes.sparkSession, path).write(changes, keys, buckets)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Snapshot: nodes by type, edges by relation; indexes are derived, never stored."""
    nodes.write.partitionBy("entity_type").mode("overwrite").parquet(f"{path}/nodes")
    edges.write.partitionBy("relation_type").mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Snapshot read; dangling edges are dropped again on load."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    ids = nodes.select("id")
    live = (edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
            .join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi"))
    return nodes, live
