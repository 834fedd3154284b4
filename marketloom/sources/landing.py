"""Normalisers from landed provider payloads to typed tables.

Each takes a DataFrame holding one payload per row and returns rows; fetching is not done
here. Payloads land as text files: `spark.read.text(dir, wholetext=True)` or the JSON, XML
and CSV readers give the input at any size.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import nz, rnd
from ..functions.scalars import clean_symbol, clean_text, number, strip

c = F.col

# Key names of three news providers → one article schema.
PROVIDERS = {
    "marketaux": {"list": "data", "content": "snippet", "url": "url", "published_at": "published_at"},
    "newsapi": {"list": "articles", "content": "content", "url": "url", "published_at": "publishedAt"},
    "newsdata": {"list": "results", "content": "content", "url": "link", "published_at": "pubDate"},
}
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def first_of(*cols: Column) -> Column:
    """First value that is neither NULL nor empty, as text alternatives are tried."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in cols])


def top_rank(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key. Spark limits each map task to k rows per key before the
    exchange, so one hot key costs no more than the others."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(c("_k") <= k).drop("_k")


def provider_articles(landed: DataFrame, provider: str, k: int = 10) -> DataFrame:
    """(ticker, payload) of one provider → articles, first k of the list per payload."""
    names = PROVIDERS[provider]
    item = f"title STRING, {names['content']} STRING, {names['url']} STRING, {names['published_at']} STRING"
    doc = F.from_json("payload", f"{names['list']} ARRAY<STRUCT<{item}>>")
    rows = landed.select("ticker", F.posexplode(F.slice(doc[names["list"]], 1, k)).alias("pos", "a"))
    return rows.select("ticker", F.lit(provider).alias("source"), "pos", nz(c("a.title"), "").alias("title"),
                       clean_text(c(f"a.{names['content']}")).alias("content"),
                       nz(c(f"a.{names['url']}"), "").alias("url"),
                       nz(c(f"a.{names['published_at']}"), "").alias("published_at"))


def raw_items(items: DataFrame, domain: str) -> DataFrame:
    """News payload columns → raw items: content else description, title first."""
    body = nz(first_of(c("content"), c("description")), "")
    title = nz(c("title"), "")
    return items.select(
        strip(F.concat(title, F.lit("\n\n"), body)).alias("text"),
        nz(first_of(c("link"), c("source_id")), "").alias("source_url"), F.lit(domain).alias("domain"),
        title.alias("title"), c("pubDate").alias("published"),
        nz(c("keywords"), F.array().cast("array<string>")).alias("tags"))


def query_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[nz(p, "") for p in parts]))


def latest_snapshot(pages: DataFrame, now: Column, ttl_hours: float, keys: list[str], at: str) -> DataFrame:
    """Rows of the newest snapshot per key that is not older than the TTL."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(c(at))
    live = pages.where((age >= 0) & (age <= ttl_hours * 3600))
    newest = live.groupBy(*keys).agg(F.max(at).alias(at))
    return live.join(newest, [*keys, at], "left_semi")


def first_per_url(items: DataFrame, order: list[str], cap: int | None = None) -> DataFrame:
    """One row per non-empty url in feed order; blank text dropped; optional report cap."""
    d = top_rank(items.where(nz(c("source_url"), "") != ""), ["source_url"], [c(o) for o in order], 1)
    if "text" in d.columns:
        d = d.where(strip(nz(c("text"), "")) != "")
    return d if cap is None else d.orderBy(*order, "source_url").limit(cap)


def gdelt_items(landed: DataFrame) -> DataFrame:
    """(query_rank, query, payload) article lists → raw items, one per url."""
    doc = F.from_json("payload", "articles ARRAY<STRUCT<url STRING, title STRING, domain STRING, seendate STRING>>")
    d = landed.select("query_rank", "query", F.posexplode(doc["articles"]).alias("pos", "a"))
    d = d.select("query_rank", "pos", c("a.url").alias("source_url"), F.concat(
        F.lit("[GDELT] "), nz(c("a.title"), ""), F.lit(". Source: "), nz(c("a.domain"), ""), F.lit(". Date: "),
        nz(c("a.seendate"), ""), F.lit(". URL: "), c("a.url")).alias("text"),
        nz(c("a.title"), "").alias("title"), F.nullif(c("a.seendate"), F.lit("")).alias("published"),
        F.concat(F.array(F.lit("GDELT"), F.lit("geopolitics")),
                 F.slice(F.split(F.lower("query"), r"\s+"), 1, 3)).alias("tags"))
    return first_per_url(d, ["query_rank", "pos"])


ACLED = ("event_id_cnty STRING, event_date STRING, event_type STRING, sub_event_type STRING, actor1 STRING, "
         "actor2 STRING, country STRING, admin1 STRING, location STRING, fatalities INT, notes STRING")


def acled_items(landed: DataFrame, since: str | None = None) -> DataFrame:
    """Conflict-event payloads → raw items."""
    e = landed.select(F.from_json("payload", ACLED).alias("e")).select("e.*")
    if since:
        e = e.where(c("event_date") >= since)
    kind = nz(first_of(c("sub_event_type"), c("event_type")), "")
    place = F.concat_ws(", ", *[F.nullif(c(x), F.lit("")) for x in ("location", "admin1", "country")])
    first = nz(c("actor1"), "Unknown")
    actors = F.when(nz(c("actor2"), "") != "", F.concat(first, F.lit(" and "), c("actor2"))).otherwise(first)
    return e.select(
        F.concat(F.lit("[ACLED] "), kind, F.lit(" involving "), actors, F.lit(" in "), place, F.lit(" on "),
                 nz(c("event_date"), ""), F.lit(". Fatalities: "), nz(c("fatalities"), 0).cast("string"), F.lit(". "),
                 F.substring(nz(c("notes"), ""), 1, 400)).alias("text"),
        F.concat(F.lit("https://acleddata.com/data/"), nz(c("event_id_cnty"), "")).alias("source_url"),
        F.concat(F.lit("ACLED: "), kind, F.lit(" – "), place).alias("title"),
        c("event_date").alias("published"),
        F.array(F.lit("ACLED"), F.lit("conflict"), F.lower(nz(c("country"), "")),
                F.lower(nz(c("event_type"), ""))).alias("tags"))


ATOM = ("entry ARRAY<STRUCT<title STRING, link STRUCT<_href STRING>, updated STRING, summary STRING, "
        "category STRUCT<_label STRING>, id STRING, author ARRAY<STRUCT<name STRING>>>>")


def atom_entries(landed: DataFrame) -> DataFrame:
    """Atom feed documents (column xml) → one row per entry."""
    feed = F.from_xml("xml", ATOM)
    return landed.select(*[x for x in landed.columns if x != "xml"], F.explode(feed["entry"]).alias("e"))


def filing_items(landed: DataFrame, form_type: str) -> DataFrame:
    """Filing feed → raw items."""
    d = atom_entries(landed).where(strip(nz(c("e.title"), "")) != "")
    title, when = strip(c("e.title")), strip(nz(c("e.updated"), ""))
    company = nz(first_of(c("e.category._label")), title)
    return d.select(
        F.concat(F.lit(f"[SEC EDGAR {form_type}] "), title, F.lit("\nFiled: "), when, F.lit(". Company: "), company,
                 F.lit(".\n"), F.substring(strip(nz(c("e.summary"), "")), 1, 400)).alias("text"),
        nz(c("e.link._href"), "").alias("source_url"), title.alias("title"), when.alias("published"))


def paper_items(landed: DataFrame) -> DataFrame:
    """Paper feed → raw items: newlines to spaces, five authors, one row per id."""
    flat = lambda x: strip(F.replace(nz(x, ""), F.lit("\n"), F.lit(" ")))
    d = atom_entries(landed).where(strip(nz(c("e.title"), "")) != "")
    d = d.select(strip(c("e.id")).alias("source_url"), flat(c("e.title")).alias("title"),
                 F.substring(flat(c("e.summary")), 1, 600).alias("summary"),
                 F.array_join(F.slice(c("e.author.name"), 1, 5), ", ").alias("authors"))
    return top_rank(d, ["source_url"], [c("title"), c("summary")], 1)


RSS = "channel STRUCT<item ARRAY<STRUCT<title STRING, link STRING, pubDate STRING, description STRING>>>"


def rss_items(landed: DataFrame, label: str, k: int = 10) -> DataFrame:
    """RSS documents with XML-illegal characters stripped, first k items, one row per link."""
    feed = F.from_xml(F.regexp_replace("xml", CONTROL, ""), RSS)
    d = landed.select("feed_rank", F.posexplode(F.slice(feed["channel"]["item"], 1, k)).alias("pos", "e"))
    d = d.select("feed_rank", "pos", strip(nz(c("e.link"), "")).alias("source_url"), strip(nz(c("e.title"), "")).alias("title"),
                 strip(nz(c("e.pubDate"), "")).alias("published"),
                 F.substring(strip(nz(c("e.description"), "")), 1, 500).alias("body"))
    d = top_rank(d, ["source_url"], [c("feed_rank"), c("pos")], 1)
    return d.select(F.concat(F.lit(f"[{label}] "), c("title"), F.lit("\n"), c("body")).alias("text"),
                    "source_url", "title", "published")


def word_positions(rows: DataFrame, text: str, name: str = "index") -> DataFrame:
    """rows with the map word → ascending positions of a text's words, inside each row: words sorted with their
    places, cut where the word changes. Nothing is shuffled; a null text has a null map."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    d = rows.withColumn("_s", F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos")))))
    at = F.sequence(F.lit(0), F.size("_s") - 1)
    first = F.filter(at, lambda i: (i == 0) | (c("_s")[i]["word"] != F.get(c("_s"), i - 1)["word"]))
    d = d.withColumn("_first", F.when(c("_s").isNotNull(), first))

    def entry(b, j):
        count = F.coalesce(F.get(c("_first"), j + 1), F.size("_s")) - b
        return F.struct(c("_s")[b]["word"].alias("word"), F.transform(F.slice("_s", b + 1, count), lambda x: x["pos"]).alias("at"))

    return d.withColumn(name, F.map_from_entries(F.transform("_first", entry))).drop("_s", "_first")


def inverted_abstract(index: Column) -> Column:
    """Word → positions map back to text in position order."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(
        e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.sort_array(pairs), lambda x: x["word"]), " ")


RELIEF = ("fields STRUCT<title STRING, body STRING, url STRING, date STRUCT<original STRING, created STRING>, "
          "source ARRAY<STRUCT<name STRING>>>")


def relief_items(landed: DataFrame) -> DataFrame:
    """Disaster reports: original date else created, body cut, source names joined."""
    d = landed.select(F.from_json("payload", RELIEF)["fields"].alias("f")).where(nz(c("f.title"), "") != "")
    names = nz(F.array_join(c("f.source.name"), ", "), "")
    return d.select(
        F.concat(F.lit("[ReliefWeb Disaster] "), c("f.title"), F.lit("\nSource: "), names, F.lit("\n"),
                 F.substring(nz(c("f.body"), ""), 1, 600)).alias("text"),
        nz(c("f.url"), "").alias("source_url"), c("f.title").alias("title"),
        nz(first_of(c("f.date.original"), c("f.date.created")), "").alias("published"))


def seed_periods(seed: DataFrame) -> DataFrame:
    """Seed rows with an "a-b" period: the end year becomes the publication date."""
    return seed.withColumn("published", F.concat(F.element_at(F.split("period", "-"), -1), F.lit("-12-31")))


def labelled(bindings: DataFrame, label: str = "label") -> DataFrame:
    """Drop rows whose label is still a bare item number."""
    return bindings.where(~c(label).rlike("^Q[0-9]+$") & (nz(c(label), "") != ""))


def members(rows: DataFrame, group: str, member: str) -> DataFrame:
    """Distinct members of every group as one text (S24); set-based partial aggregation."""
    return rows.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(member)), ", ").alias("members"))


def newest_values(series: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Newest non-null value per key."""
    return series.where(c(value).isNotNull()).groupBy(*keys).agg(
        F.max_by(value, at).alias(value), F.max(at).alias(at))


def csv_series(lines: DataFrame, take: str = "first", k: int = 15) -> DataFrame:
    """Annual series from CSV lines (line_no, line): k data rows, numeric year, column 13.
    take='first' follows the published behaviour; 'last' the described one."""
    f = F.split("line", ",")
    d = lines.withColumn("year", F.trim(F.get(f, F.lit(0)))).withColumn("annual", F.trim(F.get(f, F.lit(13))))
    d = d.where(c("line_no") >= 2)
    d = d.where(c("line_no") < 2 + k) if take == "first" else d.orderBy(c("line_no").desc()).limit(k)
    return d.where(c("year").rlike("^[0-9]+$") & c("annual").isNotNull() & ~c("annual").isin("", "***")).select(
        "year", c("annual").try_cast("double").alias("anomaly"))


def weekly_weather(landed: DataFrame) -> DataFrame:
    """Daily arrays → null-skipping mean and peak per city."""
    doc = F.from_json("payload", "daily STRUCT<time ARRAY<STRING>, temperature_2m_max ARRAY<DOUBLE>, precipitation_sum ARRAY<DOUBLE>>")
    d = landed.select("city", F.explode(F.arrays_zip(doc["daily"]["time"].alias("t"), doc["daily"]["temperature_2m_max"].alias("temp"),
                                                     doc["daily"]["precipitation_sum"].alias("rain"))).alias("x"))
    return d.groupBy("city").agg(rnd(F.avg("x.temp"), 1).alias("avg_temp"), F.max("x.temp").alias("max_temp"),
                                 rnd(F.avg("x.rain"), 1).alias("avg_rain"))


_SIDE = ("STRUCT<close STRING, price STRING, lastPrice STRING, current_price STRING, prev_close STRING, "
         "previousClose STRING, previous_close STRING>")
QUOTE = f"nse_data {_SIDE}, bse_data {_SIDE}, current_price STRING, prev_close STRING"


def quotes(landed: DataFrame) -> DataFrame:
    """Vendor quotes with alternative key names: first exchange, else the second."""
    d = landed.select("ticker", F.from_json("payload", QUOTE).alias("q"))
    d = d.select("ticker", "q", F.coalesce("q.nse_data", "q.bse_data").alias("s"))
    price = number(first_of(*[c(f"s.{k}") for k in ("close", "price", "lastPrice", "current_price")], c("q.current_price")))
    prev = number(first_of(*[c(f"s.{k}") for k in ("prev_close", "previousClose", "previous_close")], c("q.prev_close")))
    d = d.select("ticker", price.alias("price"), prev.alias("prev_close")).where(c("price").isNotNull())
    return d.withColumn("pct_change", F.when(c("prev_close") != 0, rnd((c("price") - c("prev_close")) / c("prev_close") * 100, 2)))


_ITEM = ("STRUCT<ticker STRING, symbol STRING, nse_code STRING, bse_code STRING, name STRING, price STRING, last_price STRING, "
         "close STRING, percent_change STRING, pct_change STRING, change_percent STRING, percentChange STRING>")
MOVER_KEYS = {"gainers": ["gainers", "top_gainers"], "losers": ["losers", "top_losers"]}
EXTREME_KEYS = {"highs": ["bse_52_week_high", "nse_52_week_high"], "lows": ["bse_52_week_low", "nse_52_week_low"]}


def vendor_lists(landed: DataFrame, keys: dict[str, list[str]], k: int, need_price: bool) -> DataFrame:
    """Ranked vendor lists under alternative keys → one row per listed symbol."""
    doc = F.from_json("payload", ", ".join(f"{x} ARRAY<{_ITEM}>" for xs in keys.values() for x in xs))
    lists = F.array(*[F.struct(F.lit(name).alias("list"), F.coalesce(*[
        F.when(F.size(doc[x]) > 0, doc[x]) for x in xs]).alias("items")) for name, xs in keys.items()])
    d = landed.select(F.explode(lists).alias("l")).select("l.list", F.posexplode(F.slice(c("l.items"), 1, k)).alias("pos", "e"))
    name = first_of(c("e.ticker"), c("e.symbol"), c("e.nse_code"), c("e.bse_code"), c("e.name"))
    d = d.select("list", "pos", clean_symbol(name).alias("ticker"),
                 number(first_of(c("e.price"), c("e.last_price"), c("e.close"))).alias("price"),
                 nz(number(first_of(c("e.percent_change"), c("e.pct_change"), c("e.change_percent"), c("e.percentChange"))))
                 .alias("pct_change"))
    d = d.where(c("ticker") != "")
    return d.where(c("price").isNotNull()) if need_price else d


def refresh_budget(ranked: DataFrame, by: str = "pct_change", top: int = 15, bottom: int = 5) -> DataFrame:
    """Symbols worth a live quote: both ends of a ranking (S32); two bounded top-k reports."""
    best = ranked.orderBy(c(by).desc(), "ticker").limit(top)
    worst = ranked.orderBy(c(by).asc(), c("ticker").desc()).limit(bottom)
    return best.select("ticker").union(worst.select("ticker")).distinct()


def most_cited(works: DataFrame, k: int = 5) -> DataFrame:
    """The k most cited works of every topic, most cited first (S20). works: (topic, id, citations)."""
    w = Window.partitionBy("topic").orderBy(F.col("citations").desc_nulls_last(), "id")
    return works.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
