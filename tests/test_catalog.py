"""The registry: every query has SQL or a reason, and a sample agrees with it on the small tables."""
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from marketloom.plans import catalog

QUERIES, SQL = entry.queries(), entry.oracle_sql()
SAMPLE = ["ohlcv_bars", "signal_simple", "ind_adx", "bt_trades_seeded", "news_sentiment", "event_parse", "graph_stats", "edge_dedup_conf", "pairs_affinity",
          "name_index", "watch_fire", "pat_candles", "regime_sticky", "mention_extract", "veto_gate"]


def test_every_query_has_sql():
    own = set(catalog.spark_queries())
    assert own <= set(QUERIES) and own - set(SQL) == {"kg_build"} and len(own) >= 208


def norm(v):
    return 0.0 if isinstance(v, float) and v == 0 else v


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_sample_agrees(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    df = QUERIES[name](spark, SMALL)
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(norm(x) for x in r) for r in cur.fetchall()), key=str)
    got = sorted((tuple(norm(x) for x in r) for r in df.select(*cols).collect()), key=str)
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_plan_of_the_flagship(spark):
    text = QUERIES["score_latest"](spark, SMALL)._jdf.queryExecution().toString()
    plan = text.split("== Physical Plan ==")[1]
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    full = QUERIES["score_latest"](spark, SMALL)._jdf.queryExecution().explainString(mode)
    scan = re.search(r"ReadSchema: struct<([^>]*)>", full).group(1)
    assert "l_tax" not in scan and "l_returnflag" not in scan and "l_suppkey" in scan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2 and "SortAggregate" not in plan


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_top_per_group_limits_before_the_exchange(spark):
    plan = QUERIES["topk_per_group"](spark, SMALL)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("WindowGroupLimit") == 2


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_every_table_function_can_be_called_as_described(spark):
    from marketloom.plans import functions_catalog as C
    from marketloom.plans.stream_queries import function_views
    from marketloom.sources.tables import Market

    m = Market(spark, SMALL)
    made = C.install_tables(spark, function_views(m))
    told = {r.name: r for r in C.functions(spark).collect()}
    assert sorted(made) == sorted(told)
    first = {"ticker": "'S1'", "series": "'S1'", "node": "'s1'", "wanted": "'S5'", "k": "2"}
    for name, row in told.items():
        got = spark.sql(f"SELECT * FROM {name}({', '.join(first[a] for a in row.arguments)})")
        assert ", ".join(f"{n} {t.upper()}" for n, t in got.dtypes) == row.returns
        got.collect()
    assert [r.id for r in spark.sql("SELECT id FROM search_nodes('SUPPLIER', 2)").collect()] == ["s0", "s1"]
    assert spark.sql("SELECT * FROM company_info(NULL)").collect() == [] == spark.sql("SELECT * FROM holding('no such')").collect()


def test_a_function_whose_view_is_missing_is_refused(spark):
    from marketloom.plans import functions_catalog as C

    assert C.install_tables(spark, {}) == []
    for names in (["graph_overview"], ["unheard of"]):
        with pytest.raises(KeyError):
            C.install_tables(spark, {}, names)
