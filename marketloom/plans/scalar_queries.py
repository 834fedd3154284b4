"""Projection, filter and scalar-function queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.numeric import nz, rnd
from ..operators import kg as K
from .oracle import fragment
from .registry import query
from .source_queries import clean_sql

c, e = F.col, F.expr

_SYM = "CASE s_suppkey%5 WHEN 0 THEN '^' || s_name WHEN 1 THEN s_name || '=X' WHEN 2 THEN s_name || '.BO' WHEN 3 THEN s_name || '.NS' ELSE s_name END"


@query("symbol_map", f"SELECT s_suppkey, {_SYM} || CASE WHEN s_suppkey%5=4 THEN '.NS' ELSE '' END AS feed_symbol FROM supplier")
def symbol_map(m):
    """Exchange suffix added only where none is present"""
    return m.table("supplier").select("s_suppkey", X.feed_symbol(e(_SYM)).alias("feed_symbol"))


@query("symbol_clean", f"SELECT s_suppkey, trim(replace(replace(upper({_SYM}),'.NS',''),'.BO','')) AS symbol FROM supplier")
def symbol_clean(m):
    """Upper-case symbols without exchange suffix"""
    return m.table("supplier").select("s_suppkey", X.clean_symbol(e(_SYM)).alias("symbol"))


@query("coerce_number", "SELECT o_orderkey, CASE WHEN o_orderkey%6=0 THEN NULL ELSE o_totalprice END AS value FROM orders")
def coerce_number(m):
    """Grouped digits to numbers, NULL where not a number"""
    text = F.when(c("o_orderkey") % 6 == 0, F.lit("n/a")).otherwise(F.format_number("o_totalprice", 2))
    return m.table("orders").select("o_orderkey", X.number(text).alias("value"))


@query("pct_change", "SELECT symbol, strftime(ts,'%Y-%m-%d') AS ts, CASE WHEN pc>0 THEN R2((close-pc)/pc*100) END AS pct_change FROM pb")
def pct_change(m):
    """Guarded percent change of every bar"""
    from ..functions.numeric import day
    from ..operators import indicators as I
    from ..operators.signals import pct_change as change

    d = I.prepared(m.bars).withColumn("p", change(c("close"), c("prev_close")))
    return d.select("symbol", day(c("ts")).alias("ts"), c("p").alias("pct_change"))


@query("clean_text", f"""SELECT doc_id, md5({clean_sql("text || ' Click here... [+' || CAST(n_chars AS VARCHAR) || ' chars] Market Wrap' || chr(10)")}) AS text_md5 FROM documents""")
def clean_text(m):
    """Article text without feed boilerplate"""
    t = e("text || ' Click here... [+' || CAST(n_chars AS STRING) || ' chars] Market Wrap' || chr(10)")
    return m.table("documents").select("doc_id", F.md5(X.clean_text(t)).alias("text_md5"))


NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
KEY = "trim(regexp_replace(" + NORM + ", '\\b(inc|ltd|llc|corp|corporation|limited|plc|gmbh|sa|nv|ag|co)\\b$', ''))"
_NAME = "split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || CASE doc_id%4 WHEN 0 THEN ', Ltd.' WHEN 1 THEN ' Inc' WHEN 2 THEN ' & Co' ELSE '' END"


@query("name_normalize", f"SELECT doc_id, {NORM.format(_NAME)} AS norm_name FROM documents")
def name_normalize(m):
    """Lower-case names of letters and digits only"""
    return m.table("documents").select("doc_id", X.normalize_name(e(_NAME)).alias("norm_name"))


@query("canonical_key", f"SELECT doc_id, {KEY.format(_NAME)} AS canonical_key FROM documents")
def canonical_key(m):
    """Names without one trailing legal suffix"""
    return m.table("documents").select("doc_id", X.canonical_key(e(_NAME)).alias("canonical_key"))


fragment("tok", f"SELECT doc_id, list_filter(list_distinct(string_split({NORM.format('text')}, ' ')), lambda x: x<>'') AS t, n_chars FROM documents")


@query("jaccard", """SELECT a.doc_id, R6(len(list_intersect(a.t,b.t))/CAST(len(list_distinct(list_concat(a.t,b.t))) AS DOUBLE)) AS similarity FROM tok a JOIN tok b ON b.doc_id=a.doc_id+1 WHERE len(a.t)>0 AND len(b.t)>0""")
def jaccard(m):
    """Token Jaccard of neighbouring whole texts"""
    t = m.table("documents").select("doc_id", X.tokens(c("text")).alias("t"))
    b = t.select((c("doc_id") - 1).alias("doc_id"), c("t").alias("u"))
    return (t.join(b, "doc_id").where((F.size("t") > 0) & (F.size("u") > 0))
            .select("doc_id", rnd(X.jaccard(c("t"), c("u")), 6).alias("similarity")))


_CHAT = "text || ' buy S' || CAST(conv_id%10 AS {0}) || ', S' || CAST(turn AS {0}) || ' or SELL S' || CAST(conv_id%10 AS {0}) || ' then S3, S4 AND S5'"


@query("mention_extract", f"""SELECT conv_id*1000+turn AS id, rank, symbol FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS rank FROM (
 SELECT conv_id, turn, symbol, min(pos) AS pos FROM (SELECT conv_id, turn, unnest(f) AS symbol, generate_subscripts(f,1) AS pos FROM (SELECT conv_id, turn, regexp_extract_all({_CHAT.format('VARCHAR')}, '\\b[A-Z][A-Z0-9\\-]{{1,9}}\\b') AS f FROM conversations))
 WHERE symbol IN (SELECT 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier) GROUP BY ALL)) WHERE rank<=4""")
def mention_extract(m):
    """First four known symbols named in a message"""
    d = m.table("conversations").select((c("conv_id") * 1000 + c("turn")).alias("id"), e(_CHAT.format("STRING")).alias("text"))
    return X.mentions(d, m.symbols, "id", "text").select("id", c("rank").cast("bigint").alias("rank"), "symbol")


_PUB = "CASE doc_id%4 WHEN 0 THEN '2024-01-0' || CAST(1+doc_id%9 AS {0}) || 'T10:30:00Z' WHEN 1 THEN '2024-02-1' || CAST(doc_id%9 AS {0}) WHEN 2 THEN 'yesterday' ELSE '' END"


@query("parse_published", f"SELECT doc_id, strftime(try_cast(replace({_PUB.format('VARCHAR')},'Z','') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS published FROM documents")
def parse_published(m):
    """ISO publication times, NULL when unreadable"""
    t = X.naive_timestamp(e(_PUB.format("STRING")))
    return m.table("documents").select("doc_id", F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("market_hours", """SELECT event_id, isodow(l)<6 AND hour(l)>=9 AND hour(l)<16 AS is_open, isodow(l)<6 AND hour(l)>=9 AND hour(l)<17 AS brief_window
 FROM (SELECT event_id, ts + INTERVAL '5 hours 30 minutes' AS l FROM events)""")
def market_hours(m):
    """Market session and brief window of every event"""
    return m.table("events").select("event_id", X.market_open(c("ts")).alias("is_open"), X.market_open(c("ts"), 17).alias("brief_window"))


@query("refresh_gate", """SELECT event_id, R2(epoch_ms(date_trunc('second', TIMESTAMP '2024-01-31 00:00:00') - date_trunc('second', ts))/3600000.0) AS age_hours,
 epoch_ms(TIMESTAMP '2024-01-31 00:00:00' - date_trunc('second', ts))/1000 < 10800 AS is_fresh FROM events""".replace(
    "epoch_ms(date_trunc('second', TIMESTAMP '2024-01-31 00:00:00') - date_trunc('second', ts))/3600000.0", "(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts)))/3600.0").replace(
    "epoch_ms(TIMESTAMP '2024-01-31 00:00:00' - date_trunc('second', ts))/1000 < 10800", "(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts))) < 10800"))
def refresh_gate(m):
    """Age in hours and the three-hour refresh gate"""
    age = X.age_seconds(c("ts"), F.lit("2024-01-31 00:00:00"))
    return m.table("events").select("event_id", rnd(age / 3600.0, 2).alias("age_hours"), (age < 10800).alias("is_fresh"))


@query("to_crores", "SELECT o_orderkey, CASE WHEN o_orderkey%8<>0 THEN R2(o_totalprice*1000.0/1e7) END AS crores FROM orders")
def to_crores(m):
    """Money to crores, NULL-safe"""
    x = F.when(c("o_orderkey") % 8 != 0, c("o_totalprice") * 1000.0)
    return m.table("orders").select("o_orderkey", X.to_crores(x).alias("crores"))


fragment("gnodes", """SELECT 'r'||CAST(r_regionkey AS VARCHAR) AS id, 'Region' AS entity_type, 'geography' AS domain, r_name AS name, CAST(1.0 AS DOUBLE) AS confidence, 'region_key='||CAST(r_regionkey AS VARCHAR) AS attrs, CAST(r_regionkey AS VARCHAR) AS vals FROM region
UNION ALL SELECT 'n'||CAST(n_nationkey AS VARCHAR), 'Nation', 'geography', n_name, 1.0, 'region_key='||CAST(n_regionkey AS VARCHAR), CAST(n_regionkey AS VARCHAR) FROM nation
UNION ALL SELECT 'c'||CAST(c_custkey AS VARCHAR), 'Customer', 'demand', c_name, CAST(0.5 AS DOUBLE)+(c_custkey%50)/CAST(100 AS DOUBLE), 'nation='||CAST(c_nationkey AS VARCHAR)||', sector='||c_mktsegment, CAST(c_nationkey AS VARCHAR)||' | '||c_mktsegment FROM customer
UNION ALL SELECT 's'||CAST(s_suppkey AS VARCHAR), 'Supplier', 'supply', s_name, CAST(0.6 AS DOUBLE)+(s_suppkey%40)/CAST(100 AS DOUBLE), 'nation='||CAST(s_nationkey AS VARCHAR), CAST(s_nationkey AS VARCHAR) FROM supplier
UNION ALL SELECT 'p'||CAST(p_partkey AS VARCHAR), 'Part', 'goods', p_name, CAST(0.4 AS DOUBLE)+(p_partkey%60)/CAST(100 AS DOUBLE), 'brand='||p_brand||', kind='||p_type||', size='||CAST(p_size AS VARCHAR), p_brand||' | '||p_type||' | '||CAST(p_size AS VARCHAR) FROM part""")
fragment("gedges", """SELECT 'IN_REGION:n'||CAST(n_nationkey AS VARCHAR)||':r'||CAST(n_regionkey AS VARCHAR) AS id, 'IN_REGION' AS relation_type, 'n'||CAST(n_nationkey AS VARCHAR) AS from_id, 'r'||CAST(n_regionkey AS VARCHAR) AS to_id, CAST(1 AS DOUBLE) AS weight, TIMESTAMP '2001-01-01' AS created_at, CAST(1 AS DOUBLE) AS confidence FROM nation
UNION ALL SELECT 'LOCATED_IN:c'||CAST(c_custkey AS VARCHAR)||':n'||CAST(c_nationkey AS VARCHAR), 'LOCATED_IN', 'c'||CAST(c_custkey AS VARCHAR), 'n'||CAST(c_nationkey AS VARCHAR), 1, TIMESTAMP '2001-01-01', 0.9 FROM customer
UNION ALL SELECT 'LOCATED_IN:s'||CAST(s_suppkey AS VARCHAR)||':n'||CAST(s_nationkey AS VARCHAR), 'LOCATED_IN', 's'||CAST(s_suppkey AS VARCHAR), 'n'||CAST(s_nationkey AS VARCHAR), 1, TIMESTAMP '2001-01-01', 0.9 FROM supplier
UNION ALL SELECT 'SUPPLIES:s'||CAST(l_suppkey AS VARCHAR)||':p'||CAST(l_partkey AS VARCHAR), 'SUPPLIES', 's'||CAST(l_suppkey AS VARCHAR), 'p'||CAST(l_partkey AS VARCHAR), least(sum(l_quantity)/100, 1), min(l_shipdate), 0.8 FROM lineitem GROUP BY l_suppkey, l_partkey""")

ALLOWED = {"Customer": ["sector"], "Supplier": ["nation"], "Part": ["brand", "kind"]}


@query("sanitize_attrs", """SELECT id, CASE entity_type WHEN 'Customer' THEN 'sector' WHEN 'Supplier' THEN 'nation' WHEN 'Part' THEN 'brand,kind' ELSE 'region_key' END AS keys FROM gnodes""")
def sanitize_attrs(m):
    """Attribute whitelist per entity type; unknown types pass through"""
    d = K.sanitize(m.nodes, K.allowed_attributes(m.spark, ALLOWED))
    return d.select("id", F.array_join(F.array_sort(F.map_keys("attributes")), ",").alias("keys"))


@query("valid_types", """SELECT conv_id*1000+turn AS id, CASE turn%4 WHEN 0 THEN 'corporate' WHEN 1 THEN 'climate' WHEN 2 THEN 'geopolitics' END AS domain FROM conversations WHERE turn%4<3""")
def valid_types(m):
    """Known entity types and the domain that defines them"""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Organization", "ClimateEvent", "Country", "Spaceship")]), (c("turn") % 4 + 1).cast("int"))
    d = m.table("conversations").select((c("conv_id") * 1000 + c("turn")).alias("id"), kind.alias("entity_type"))
    return K.with_valid_type(d, K.ontology_types(m.spark)).select("id", "domain")


@query("node_text", """SELECT id, name || ' | ' || entity_type || ' | ' || lower(name) || ' | ' || vals AS text FROM gnodes""")
def node_text(m):
    """Search text of every node"""
    none = F.lit(None).cast("string")
    return m.nodes.select("id", X.node_text(c("canonical_name"), c("entity_type"), none, c("aliases"), none, c("attributes")).alias("text"))


@query("node_names", "SELECT id, name || '|' || lower(name) AS names FROM gnodes")
def node_names(m):
    """All names of every node"""
    return m.nodes.select("id", F.array_join(X.all_names(c("canonical_name"), c("aliases")), "|").alias("names"))


@query("graph_labels", """SELECT id, CASE WHEN length(id)>22 THEN substr(id,1,20) || '…' ELSE id END AS label, CASE WHEN confidence<0.85 THEN 'inferred' ELSE lower(replace(relation_type,'_',' ')) END AS edge_label FROM gedges""")
def graph_labels(m):
    """Short labels for nodes and edges"""
    inferred = F.when(c("confidence") < 0.85, F.lit("inferred"))
    return m.edges.select("id", X.short_label(c("id")).alias("label"), X.edge_label(c("relation_type"), inferred).alias("edge_label"))


_DOC = "'Sure!```json' || chr(10) || '{{\"id\": ' || CAST(doc_id AS {0}) || ', \"note\": \"' || CASE WHEN doc_id%3=0 THEN 'a' || chr(1) || 'b' ELSE 'ok' END || '\"}}' || chr(10) || '```' || CASE WHEN doc_id%5=0 THEN '' ELSE ' bye' END"


@query("json_recover", "SELECT doc_id, doc_id AS id, CASE WHEN doc_id%3=0 THEN 'ab' ELSE 'ok' END AS note FROM documents")
def json_recover(m):
    """Object hidden in fenced model text"""
    d = m.table("documents").select("doc_id", X.recover_json(e(_DOC.format("STRING")), "id BIGINT, note STRING").alias("o"))
    return d.select("doc_id", "o.id", "o.note")


@query("json_array_recover", "SELECT doc_id, 3 AS size, R3(doc_id%7 + 0.75) AS total FROM documents")
def json_array_recover(m):
    """Number array hidden in model text"""
    t = e("'Scores: [' || CAST(doc_id%7 AS STRING) || ', 0.25, 0.5] done'")
    d = m.table("documents").select("doc_id", X.recover_array(t).alias("a"))
    return d.select("doc_id", F.size("a").alias("size"), rnd(F.aggregate("a", F.lit(0.0), lambda x, y: x + y), 3).alias("total"))


@query("entity_snippet", "SELECT id, name || ' (' || entity_type || '/' || domain || ') ' || attrs AS snippet FROM gnodes")
def entity_snippet(m):
    """One-line description of every node"""
    return m.nodes.select("id", X.snippet(c("canonical_name"), c("entity_type"), c("domain"), c("attributes")).alias("snippet"))
