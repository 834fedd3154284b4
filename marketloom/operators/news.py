"""News cleaning, weighting and sentiment."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import lookup, nz, rnd
from ..functions.scalars import title_key
from ..sources.landing import top_rank
from ..sources.tables import SOURCE_WEIGHT
from .graph import make_edges, make_nodes

c = F.col
# Weight by age in days; unknown sources and unreadable dates get the lowest.
RECENCY_WEIGHT = {0: 1.0, 1: 0.8, 2: 0.5}
PROVIDER_ORDER = {"marketaux": 0, "newsapi": 1, "newsdata": 2}


def dedup_titles(articles: DataFrame) -> DataFrame:
    """First article per (ticker, title key) in provider order."""
    d = articles.withColumn("key", title_key(c("title"))).where(c("key") != "")
    return top_rank(d, ["ticker", "key"], [lookup(c("source"), PROVIDER_ORDER, 3), c("doc_id")], 1)


def weight(source: Column, published: Column, as_of: Column) -> Column:
    """Source weight × recency weight."""
    days = F.least(nz(F.datediff(as_of, F.left(published, F.lit(10)).try_cast("date")), 2), F.lit(2))
    return lookup(source, SOURCE_WEIGHT, 0.5) * lookup(days, RECENCY_WEIGHT, 0.5)


def weighted(articles: DataFrame, scores: DataFrame, as_of: str) -> DataFrame:
    """Articles with weight and per-article score; unscored items count as neutral."""
    d = articles.join(scores, "doc_id", "left").withColumn("raw_score", nz(c("raw_score")))
    return d.withColumn("weight", weight(c("source"), c("published_at"), F.lit(as_of).cast("date")))


def sentiment(items: DataFrame) -> DataFrame:
    """Weighted mean per ticker (N03); partial sums combine map-side, so hot tickers are cheap."""
    g = items.groupBy("ticker").agg(F.sum(c("raw_score") * c("weight")).alias("s"), F.sum("weight").alias("w"),
                                    F.count(F.lit(1)).alias("articles_found"))
    return g.select("ticker", F.when(c("w") > 0, rnd(c("s") / c("w"), 4)).otherwise(0.0).alias("score"), "articles_found")


def feed_order() -> list[Column]:
    return [lookup(c("source"), PROVIDER_ORDER, 3), c("doc_id")]


def headlines(items: DataFrame, k: int = 5) -> DataFrame:
    d = top_rank(items, ["ticker"], feed_order(), k)
    order = lookup(c("source"), PROVIDER_ORDER, 3)
    return d.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("p"), "doc_id", "title"))),
                                               lambda x: x["title"]).alias("top_headlines"))


def records(symbols: DataFrame, items: DataFrame) -> DataFrame:
    """Sentiment record for every symbol; a neutral one where there is no news."""
    d = symbols.select(c("symbol").alias("ticker")).join(sentiment(items), "ticker", "left").join(headlines(items), "ticker", "left")
    found = nz(c("articles_found"), 0)
    return d.select("ticker", nz(c("score")).alias("score"),
                    F.when(found == 0, "No news found.").otherwise(
                        F.concat(found.cast("string"), F.lit(" articles; latest: "), F.element_at("top_headlines", 1))).alias("headline_summary"),
                    found.cast("bigint").alias("articles_found"),
                    F.coalesce("top_headlines", F.array().cast("array<string>")).alias("top_headlines"))


def with_fallback(symbols: DataFrame, external: DataFrame, local: DataFrame) -> DataFrame:
    """External record per ticker, else the local one."""
    e = external.select("ticker", c("score").alias("_e"), c("articles_found").alias("_en"))
    d = symbols.select(c("symbol").alias("ticker")).join(e, "ticker", "left").join(local, "ticker", "left")
    return d.select("ticker", F.coalesce("_e", "score").alias("score"),
                    F.coalesce("_en", "articles_found").alias("articles_found"),
                    F.when(c("_e").isNotNull(), "external").otherwise("local").alias("origin"))


def scorer_input(items: DataFrame, k: int = 12, cut: int = 300) -> DataFrame:
    """One prompt text per ticker from its first k items, ready for a batch scorer."""
    d = top_rank(items, ["ticker"], feed_order(), k)
    line = F.concat(F.lit("- ["), c("source"), F.lit("] "), c("title"), F.lit(": "), F.substring(nz(c("content"), ""), 1, cut))
    order = lookup(c("source"), PROVIDER_ORDER, 3)
    return d.groupBy("ticker").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(order.alias("p"), "doc_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("input"))


ANALYSIS = ("sentiment_score DOUBLE, summary STRING, key_events ARRAY<STRUCT<title STRING, event_type STRING, "
            "description STRING, magnitude DOUBLE>>")


def scored_events(answers: DataFrame) -> DataFrame:
    """(ticker, answer JSON) → titled events with defaults."""
    d = answers.select("ticker", F.posexplode(F.from_json("answer", ANALYSIS)["key_events"]).alias("pos", "e"))
    d = d.where(nz(c("e.title"), "") != "")
    return d.select("ticker", "pos", c("e.title").alias("title"), nz(c("e.event_type"), "other").alias("event_type"),
                    c("e.description").alias("description"), nz(c("e.magnitude"), 0.5).alias("magnitude"))


def to_graph(items: DataFrame, scores: DataFrame, events: DataFrame, companies: DataFrame, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """News and event nodes with edges from existing company nodes.
    companies: (ticker, company_id)."""
    top = top_rank(items, ["ticker"], feed_order(), k).join(scores.select("ticker", c("score").alias("ticker_score")), "ticker", "left")
    key = [c("ticker"), c("source"), c("doc_id").cast("string")]
    news = make_nodes(top, "NewsItem", F.substring("title", 1, 200), key, F.substring("content", 1, 500), c("ticker"),
                      F.array("source"), source=c("source"), url=c("url"), published_at=c("published_at"),
                      sentiment_score=nz(c("ticker_score")))
    link = top.join(companies, "ticker")
    from .graph import node_id
    mention = make_edges(link, "MENTIONED_IN", c("company_id"), node_id(F.lit("NewsItem"), *key),
                         lookup(c("source"), SOURCE_WEIGHT, 0.5), F.abs(nz(c("ticker_score"))))
    ekey = [c("ticker"), c("title"), c("event_type")]
    ev = make_nodes(events, "Event", c("title"), ekey, c("description"), c("ticker"), F.array(F.lit("news")),
                    event_type=c("event_type"), magnitude=c("magnitude"))
    had = make_edges(events.join(companies, "ticker"), "HAD_EVENT", c("company_id"), node_id(F.lit("Event"), *ekey))
    return news.union(ev), mention.union(had)
