"""Typed market tables derived lazily from a folder of parquet tables."""
from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numeric import lookup
from ..session import cut_lineage

# Provider weights and the reference date all ages are measured from.
SOURCE_WEIGHT = {"marketaux": 1.0, "newsapi": 0.7, "newsdata": 0.5}
AS_OF = "2024-01-31"
GRAPH_AS_OF = "2002-01-01"


def build_bars(ticks: DataFrame, key: Column, ts: Column, price: Column, qty: Column,
               order: Column, unit: str = "week") -> DataFrame:
    """OHLCV bars from ticks (S07). One map-side-combined aggregate: a key that holds a
    third of all ticks still reaches the reducers as one row per bar and map task."""
    return (
        ticks.select(key.alias("_k"), F.date_trunc(unit, ts).cast("timestamp").alias("ts"),
                     price.alias("_p"), qty.alias("_q"), order.alias("_o"))
        .groupBy("_k", "ts")
        .agg(F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"),
             F.min("_p").alias("low"), F.max_by("_p", "_o").alias("close"),
             F.sum("_q").alias("volume"))
        .withColumnRenamed("_k", "symbol")
    )


def tick_order() -> Column:
    """Order of line items within a week as one long (day, order, line, tie-break): a long key
    keeps min_by/max_by in the hash aggregate, where a struct key would force a sort."""
    c = F.col
    cents = F.floor(c("l_extendedprice") * 100 + 0.5)
    tie = (c("l_partkey") * 31 + cents + c("l_quantity").cast("bigint")) % 4096
    return (F.weekday("l_shipdate").cast("bigint") * (1 << 60) + c("l_orderkey") * (1 << 15)
            + c("l_linenumber") * 4096 + tie)


def time_order(ts: Column, seq: Column) -> Column:
    """Order of ticks inside a day as one long: microseconds of the day, then the tick's number."""
    return F.unix_micros(ts) % 86_400_000_000 * (1 << 26) + seq % (1 << 26)


class Market:
    """The given tables and the market tables derived from them; nothing runs until used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def bars(self) -> DataFrame:
        c = F.col
        bars = build_bars(
            self.table("lineitem"), c("l_suppkey"), c("l_shipdate"),
            c("l_extendedprice") / c("l_quantity"), c("l_quantity"),
            tick_order())
        return bars.withColumn("symbol", F.concat(F.lit("S"), c("symbol").cast("string")))

    @cached_property
    def kept_bars(self) -> DataFrame:
        """The bars computed once and kept in the shared folder, for queries that pass over them several times."""
        return cut_lineage(self.bars)

    def once(self, name: str, build: Callable[[Market], DataFrame]) -> DataFrame:
        """A table of few rows per symbol that several parts of one query use, computed once."""
        if name not in self._kept:
            self._kept[name] = cut_lineage(build(self))
        return self._kept[name]

    @cached_property
    def ticks(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
            F.col("value").alias("price"), F.lit(1.0).alias("qty"), F.col("event_id").alias("seq"))

    @cached_property
    def hourly_bars(self) -> DataFrame:
        c = F.col
        return build_bars(self.ticks, c("symbol"), c("ts"), c("price"), c("qty"), time_order(c("ts"), c("seq")), "hour")

    @cached_property
    def symbols(self) -> DataFrame:
        return self.table("supplier").select(
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"),
            F.col("s_suppkey").alias("rank"),
            (F.col("s_suppkey") % 2 == 0).alias("in_watchlist"))

    @cached_property
    def symbol_count(self) -> Column:
        return self.table("supplier").agg(F.count("*")).scalar()

    @cached_property
    def articles(self) -> DataFrame:
        doc = F.col("doc_id")
        provider = lookup(doc % 4, {0: "marketaux", 1: "newsapi", 2: "newsdata"})
        return self.table("documents").select(
            F.concat(F.lit("S"), (doc % self.symbol_count).cast("string")).alias("ticker"),
            doc,
            F.coalesce(provider, F.col("source")).alias("source"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("content"),
            F.concat(F.lit("https://news.example/"), (doc % 700).cast("string")).alias("url"),
            F.date_format(F.expr("date_add(DATE '2024-01-01', CAST(doc_id % 30 AS INT))"),
                          "yyyy-MM-dd").alias("published_at"))

    @cached_property
    def item_scores(self) -> DataFrame:
        """Deterministic per-item score standing in for a model: (doc_id, raw_score)."""
        return self.table("labels").groupBy("doc_id").agg(
            F.max((2 * F.col("quality") - 1) * (1 - F.col("toxic"))).cast("double")
            .alias("raw_score"))

    @cached_property
    def nodes(self) -> DataFrame:
        def part_of(table, kind, domain, key, name, extra, conf):
            t = self.table(table)
            return t.select(
                F.concat(F.lit(kind[0].lower()), F.col(key).cast("string")).alias("id"),
                F.lit(kind).alias("entity_type"), F.lit(domain).alias("domain"),
                F.col(name).alias("canonical_name"),
                F.array(F.lower(F.col(name))).alias("aliases"),
                F.create_map(*[x for k, v in extra.items()
                               for x in (F.lit(k), v.cast("string"))]).alias("attributes"),
                F.array(F.lit(table)).alias("sources"), conf.alias("confidence"))

        c = F.col
        full = F.lit(1.0)
        return (
            part_of("region", "Region", "geography", "r_regionkey", "r_name",
                    {"region_key": c("r_regionkey")}, full)
            .unionByName(part_of("nation", "Nation", "geography", "n_nationkey", "n_name",
                                 {"region_key": c("n_regionkey")}, full))
            .unionByName(part_of("customer", "Customer", "demand", "c_custkey", "c_name",
                                 {"sector": c("c_mktsegment"), "nation": c("c_nationkey")},
                                 F.lit(0.5) + (c("c_custkey") % 50) / F.lit(100.0)))
            .unionByName(part_of("supplier", "Supplier", "supply", "s_suppkey", "s_name",
                                 {"nation": c("s_nationkey")},
                                 F.lit(0.6) + (c("s_suppkey") % 40) / F.lit(100.0)))
            .unionByName(part_of("part", "Part", "goods", "p_partkey", "p_name",
                                 {"brand": c("p_brand"), "kind": c("p_type"), "size": c("p_size")},
                                 F.lit(0.4) + (c("p_partkey") % 60) / F.lit(100.0)))
        )

    @cached_property
    def edges(self) -> DataFrame:
        c = F.col

        def rel(df, kind, a, b, weight, born, conf):
            return df.select(F.concat_ws(":", F.lit(kind), a, b).alias("id"),
                             F.lit(kind).alias("relation_type"), a.alias("from_id"), b.alias("to_id"),
                             weight.alias("weight"), born.alias("created_at"), conf.alias("confidence"))

        def ref(letter, col):
            return F.concat(F.lit(letter), c(col).cast("string"))

        epoch = F.lit("2001-01-01").cast("timestamp")
        supplied = (
            self.table("lineitem").groupBy("l_suppkey", "l_partkey")
            .agg(F.sum("l_quantity").alias("q"), F.min("l_shipdate").cast("timestamp").alias("born")))
        return (
            rel(self.table("nation"), "IN_REGION", ref("n", "n_nationkey"), ref("r", "n_regionkey"),
                F.lit(1.0), epoch, F.lit(1.0))
            .unionByName(rel(self.table("customer"), "LOCATED_IN", ref("c", "c_custkey"),
                             ref("n", "c_nationkey"), F.lit(1.0), epoch, F.lit(0.9)))
            .unionByName(rel(self.table("supplier"), "LOCATED_IN", ref("s", "s_suppkey"),
                             ref("n", "s_nationkey"), F.lit(1.0), epoch, F.lit(0.9)))
            .unionByName(rel(supplied, "SUPPLIES", ref("s", "l_suppkey"), ref("p", "l_partkey"),
                             F.least(c("q") / F.lit(100.0), F.lit(1.0)), c("born"), F.lit(0.8)))
        )

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "embedding", "label")

    @cached_property
    def holdings(self) -> DataFrame:
        """One holding per supplier whose key is divisible by five."""
        return (self.table("lineitem").where(F.col("l_suppkey") % 5 == 0).groupBy("l_suppkey")
                .agg(F.sum("l_quantity").alias("quantity"),
                     (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("avg_cost"))
                .select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
                        F.col("l_suppkey").alias("pos"), "quantity", "avg_cost"))
