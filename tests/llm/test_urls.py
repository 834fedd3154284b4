import duckdb
from marketloom.llm import queries, url_filter

PAGES = "page_id long, url string, html string, host string, rule int"


def link(to):
    return f'<html><head><link rel="canonical" href="{to}"></head></html>'


def moved(to):
    return f'<META HTTP-EQUIV=refresh content="0; URL={to}">'


ROWS = [
    (1, "http://a.example.com/x", moved("http://bad.net/")), (2, "https://a.example.com/y?utm_source=z", link("http://a.example.com/x")),
    (3, "http://a.example.com/de/q", None), (4, "http://b.org/fr/1", link("/de")), (5, "http://b.org/de", moved("//evil.net/p")),
    (6, "http://www.EXAMPLE.net/en/1", link("http://bad.net/")), (7, "http://net", ""), (8, "http://net/", ""), (9, "no scheme", link("http://bad.net/")), (10, None, None),
    (11, "http://c.example.com/one", link("two#frag")), (12, "http://c.example.com/two", ""), (13, "ftp://c.example.com?q=1", ""), (14, "http://aexample.com/de/", ""),
    (15, "http://a.example.com/y#top", "")]
WANT = {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow", 7: "allow", 8: "block", 9: "allow", 10: "allow", 11: "allow", 12: "allow", 13: "allow", 14: "allow", 15: "block"}


def test_block_reaches_aliases_and_allow_wins(spark):
    rows = url_filter.judge(spark.createDataFrame([(*r, "clash", 1) for r in ROWS], PAGES)).collect()
    assert {r.page_id: r.verdict for r in rows} == WANT
    own = {r.page_id: (r.host, r.path, r.rule) for r in rows}
    assert own[6] == ("www.example.net", "/en/1", "example.net/en/") and own[7] == ("net", "", None) and own[10] == ("", "", None) and own[4][2] == "org/fr/"
    assert {r.page_id for r in rows if r.blocked_by_alias} == {1, 2, 5, 15}


def test_sql_agrees(spark, tmp_path):
    docs = spark.createDataFrame([r for r in ROWS], "page_id long, url string, html string")
    docs.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.SQL["op6_url_filter"])
    names = [c[0] for c in want.description]
    got = queries.QUERIES["op6_url_filter"](spark, str(tmp_path)).select(*names).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {r[0]: (r[1] or "", r[2] or "", r[3], r[4]) for r in want.fetchall()}


def test_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], PAGES)).count() == 0
