"""Landing normalisers on small literal payloads and files."""
from pyspark.sql import functions as F

from marketloom.functions import scalars as X
from marketloom.sources import landing as L, store as B


def one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols))


def test_provider_and_quote_variants(spark):
    d = one(spark, ticker="T", payload='{"results":[{"title":"x","content":"Click here y... [+12 chars]","link":"u","pubDate":"p"},{"title":null}]}')
    got = L.provider_articles(d, "newsdata").orderBy("pos").collect()
    assert (got[0].title, got[0].content, got[0].url) == ("x", "y.", "u") and got[1].title == ""
    q = spark.createDataFrame([("A", '{"bse_data":{"lastPrice":"1,200.5","previous_close":"1000"}}'), ("B", '{"current_price":"7"}'), ("C", '{"nse_data":{"close":"n/a"}}')], "ticker string, payload string")
    got = {r.ticker: (r.price, r.pct_change) for r in L.quotes(q).collect()}
    assert got == {"A": (1200.5, 20.05), "B": (7.0, None)}


def test_xml_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<feed><entry><title> A\nB </title><link href="u"/><updated>2024</updated><summary>s</summary><id>1</id>'
                                    '<author><name>P</name></author><author><name>Q</name></author></entry><entry><title></title></entry></feed>')
    x = spark.read.text(str(tmp_path), wholetext=True).withColumnRenamed("value", "xml")
    assert [(r.source_url, r.published) for r in L.filing_items(x, "8-K").collect()] == [("u", "2024")]
    assert [(r.title, r.authors) for r in L.paper_items(x).collect()] == [("A B", "P, Q")]


def test_rss_control_characters_and_links(spark):
    item = "<item><title>{}</title><link>l</link><description>d\x0b</description></item>"
    d = spark.createDataFrame([(0, f"<rss><channel>{item.format('a')}{item.format('b')}</channel></rss>")], "feed_rank int, xml string")
    assert [(r.title, r.text) for r in L.rss_items(d, "X").collect()] == [("a", "[X] a\nd")]


def test_series_and_abstract(spark):
    lines = [(k, f"{1878 + k}" + "," * 13 + ("***" if k == 5 else f"{k / 10}")) for k in range(2, 30)] + [(0, "t"), (1, "Year,Jan")]
    d = spark.createDataFrame(lines, "line_no int, line string")
    first, last = L.csv_series(d).count(), [r.year for r in L.csv_series(d, take="last").collect()]
    assert first == 14 and max(last) == "1907" and len(last) == 15
    a = spark.sql("SELECT map('b', array(1, 3), 'a', array(0), 'c', array(2)) AS m")
    assert a.select(L.inverted_abstract(F.col("m")).alias("t")).first().t == "a b c b"


def test_acled_missing_parts(spark):
    d = one(spark, payload='{"event_id_cnty":"X1","event_date":"2024-01-02","event_type":"Riot","country":"C","location":"","notes":null}')
    r = L.acled_items(d).first()
    assert r.text == "[ACLED] Riot involving Unknown in C on 2024-01-02. Fatalities: 0. " and r.title == "ACLED: Riot – C"


def test_json_recovery(spark):
    rows = [('x ```json\n{"id": 1, "note": "a"}\n``` y',), ('{"id": 2, "note": "b\nc"}',), ("none",)]
    d = spark.createDataFrame(rows, "t string").select(X.recover_json(F.col("t"), "id INT, note STRING").alias("o"))
    assert [(r.o.id, r.o.note) if r.o else None for r in d.collect()][:2] == [(1, "a"), (2, "bc")]


def test_bar_store(spark, walk, tmp_path):
    bars, pdf = walk
    path = str(tmp_path / "bars")
    B.write_bars(bars, path)
    B.write_bars(bars.where("symbol = 'A'").limit(5), path)
    back = B.read_bars(spark, path, ["A", "B"])
    assert back.where("symbol = 'B'").count() == 260
    assert back.where("symbol = 'A'").count() == 5


def test_normalize_bars(spark):
    d = spark.createDataFrame([("S", "2024-01-02", 1.0, 2.0, 0.5, 1.5), ("S", "bad", 1.0, 2.0, 0.5, 1.5), ("S", "2024-01-03", None, 2.0, 0.5, 1.5)],
                              "symbol string, Date string, Open double, High double, Low double, Close double")
    assert [(str(r.ts)[:10], r.volume) for r in B.normalize_bars(d).collect()] == [("2024-01-02", 0.0)]


def test_word_positions_are_made_inside_each_row(spark):
    d = spark.createDataFrame([(1, " b a\tb  c"), (1, "a"), (2, ""), (3, None)], "doc_id int, text string")
    e = L.word_positions(d, "text")
    got = [(r.doc_id, r["index"]) for r in e.collect()]
    assert got == [(1, {"b": [0, 2], "a": [1], "c": [3]}), (1, {"a": [0]}), (2, {"": [0]}), (3, None)]
    assert [r.t for r in e.select(L.inverted_abstract(F.col("index")).alias("t")).collect()] == ["b a b c", "a", "", None]


def test_abstracts_are_inverted_without_a_shuffle(spark, tmp_path):
    from marketloom.plans import catalog
    spark.createDataFrame([(1, "a b"), (1, "c"), (2, None)], "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    d = catalog.spark_queries()["invert_abstract"](spark, str(tmp_path))
    assert d.count() == 3
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
