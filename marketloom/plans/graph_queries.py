"""Property-graph and knowledge-graph queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.numeric import lookup, nz, rnd
from ..operators import graph as G, kg as K, vectors as V
from ..sources import landing as L, store as B
from ..sources.tables import GRAPH_AS_OF
from .oracle import fragment
from .registry import query
from .scalar_queries import KEY, NORM

c, e = F.col, F.expr


def now():
    return F.lit(GRAPH_AS_OF).cast("timestamp")


def suppliers(m):
    return m.nodes.where(c("entity_type") == "Supplier").select("id")


def nations(m):
    return m.nodes.where(c("entity_type") == "Nation").select("id")


EFF = f"g.weight * pow(2.0, -floor((epoch(TIMESTAMP '{GRAPH_AS_OF}')-epoch(g.created_at))/86400.0)/180.0) * g.confidence"


@query("node_insert", "SELECT id, name AS canonical_name FROM gnodes UNION ALL SELECT 'x' || CAST(o_custkey AS VARCHAR), 'order ' || CAST(min(o_orderkey) AS VARCHAR) FROM orders WHERE o_custkey%2=1 GROUP BY o_custkey")
def node_insert(m):
    """Insert-if-absent: known ids stay, the first arrival of a new id wins"""
    k = c("o_custkey").cast("string")
    new = m.table("orders").select(F.when(c("o_custkey") % 2 == 0, F.concat(F.lit("c"), k)).otherwise(F.concat(F.lit("x"), k)).alias("id"),
                                   F.concat(F.lit("order "), c("o_orderkey").cast("string")).alias("canonical_name"), c("o_orderkey").alias("arrival"))
    return G.insert_absent(m.nodes.select("id", "canonical_name"), new, "arrival")


@query("node_upsert", "SELECT id, CASE WHEN entity_type='Supplier' THEN upper(name) ELSE name END AS canonical_name FROM gnodes")
def node_upsert(m):
    """Replace by id"""
    n = m.nodes.select("id", "entity_type", "canonical_name")
    new = n.where(c("entity_type") == "Supplier").withColumn("canonical_name", F.upper("canonical_name"))
    return G.replace_nodes(n, new).select("id", "canonical_name")


@query("node_delete", "SELECT relation_type, count(*) AS edges FROM gedges WHERE from_id NOT LIKE 's%' GROUP BY 1")
def node_delete(m):
    """Delete nodes with their edges"""
    _, edges = G.delete_nodes(m.nodes, m.edges, suppliers(m))
    return edges.groupBy("relation_type").agg(F.count(F.lit(1)).alias("edges"))


@query("node_lookup", "SELECT id, name AS canonical_name FROM gnodes WHERE entity_type='Supplier' AND domain='supply'")
def node_lookup(m):
    """Nodes of one type and domain"""
    return m.nodes.where((c("entity_type") == "Supplier") & (c("domain") == "supply")).select("id", "canonical_name")


# raw edges: every line item is one supply edge, with repeats and dangling ends
fragment("raw_e", """SELECT l_orderkey*8+l_linenumber AS arrival, 's' || CAST(l_suppkey AS VARCHAR) AS from_id, CASE WHEN l_partkey%10=0 THEN 'zz' ELSE 'p' END || CAST(l_partkey AS VARCHAR) AS to_id,
 'SUPPLIES' AS relation_type, l_quantity AS weight, l_discount AS confidence, l_returnflag AS src, row(l_orderkey*8+l_linenumber, l_quantity, l_extendedprice, l_discount) AS o FROM lineitem""")


def raw_edges(m):
    arrival = F.struct((c("l_orderkey") * 8 + c("l_linenumber")).alias("a"), c("l_quantity").alias("b"), c("l_extendedprice").alias("c"), c("l_discount").alias("d"))
    return m.table("lineitem").select(
        arrival.alias("arrival"), F.concat(F.lit("s"), c("l_suppkey").cast("string")).alias("from_id"),
        F.concat(F.when(c("l_partkey") % 10 == 0, "zz").otherwise("p"), c("l_partkey").cast("string")).alias("to_id"), F.lit("SUPPLIES").alias("relation_type"),
        c("l_quantity").alias("weight"), c("l_discount").alias("confidence"), F.array("l_returnflag").alias("sources"))


@query("edge_dedup_first", "SELECT from_id, to_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id ORDER BY o) AS r FROM raw_e WHERE to_id LIKE 'p%') WHERE r=1", bounded=True)
def edge_dedup_first(m):
    """First edge per (from, to, type), dangling edges dropped"""
    return G.first_edges(raw_edges(m), m.nodes, "arrival").select("from_id", "to_id", "weight")


@query("edge_dedup_conf", """SELECT from_id, to_id, weight, confidence, src AS source FROM (SELECT from_id, to_id, arg_min(weight, row(-confidence, o)) AS weight, max(confidence) AS confidence FROM raw_e WHERE to_id LIKE 'p%' GROUP BY 1,2)
 JOIN (SELECT DISTINCT from_id, to_id, src FROM raw_e) USING (from_id, to_id)""", bounded=True)
def edge_dedup_conf(m):
    """Most confident edge per (from, to, type) beside each of its sources"""
    raw = raw_edges(m)
    d = G.winning_edges(raw, m.nodes, "arrival").join(G.edge_sources(raw), G.EDGE)
    return d.select("from_id", "to_id", "weight", "confidence", "source")


@query("edges_of", "SELECT id, 'out' AS direction FROM gedges WHERE from_id='n1' UNION ALL SELECT id, 'in' FROM gedges WHERE to_id='n1'")
def edges_of(m):
    """Out- and in-edges of a node"""
    return (m.edges.where(c("from_id") == "n1").select("id", F.lit("out").alias("direction"))
            .union(m.edges.where(c("to_id") == "n1").select("id", F.lit("in"))))


@query("one_hop", f"SELECT g.id, t.name AS target, t.entity_type AS target_type, R6({EFF}) AS effective_weight FROM gedges g JOIN gnodes t ON t.id=g.to_id WHERE g.from_id LIKE 's%'", bounded=True)
def one_hop(m):
    """Targets one hop from every supplier with decayed weight"""
    d = G.one_hop(m.edges, m.nodes, suppliers(m), now())
    return d.select("id", "target", "target_type", rnd(c("effective_weight"), 6).alias("effective_weight"))


@query("edge_decay", f"SELECT g.id, R6({EFF}) AS effective_weight FROM gedges g", bounded=True)
def edge_decay(m):
    """Decayed weight of every edge"""
    return m.edges.select("id", rnd(G.edge_weight(now()), 6).alias("effective_weight"))


fragment("bidir", "SELECT from_id AS src, to_id AS tgt, id FROM gedges UNION ALL SELECT to_id, from_id, 'back:' || id FROM gedges WHERE relation_type='IN_REGION'")
fragment("hop1", "SELECT start, tgt, min(row(src, id)) AS v FROM (SELECT DISTINCT 'c' || CAST(c_custkey AS VARCHAR) AS start FROM customer) s JOIN bidir ON src=start GROUP BY 1,2")
fragment("hop2", "SELECT h.start, b.tgt, min(row(b.src, b.id)) AS v FROM hop1 h JOIN bidir b ON b.src=h.tgt WHERE (h.start, b.tgt) NOT IN (SELECT (start, tgt) FROM hop1) GROUP BY 1,2")
fragment("hop3", "SELECT h.start, b.tgt, min(row(b.src, b.id)) AS v FROM hop2 h JOIN bidir b ON b.src=h.tgt WHERE (h.start, b.tgt) NOT IN (SELECT (start, tgt) FROM hop1 UNION ALL SELECT (start, tgt) FROM hop2) GROUP BY 1,2")


def walk_edges(m):
    """All edges plus region → nation back edges, so that walks meet cycles."""
    loc = m.edges.select("id", "from_id", "to_id")
    back = m.edges.where(c("relation_type") == "IN_REGION").select(F.concat(F.lit("back:"), "id"), c("to_id"), c("from_id"))
    return loc.union(back)


@query("khop_directed", """SELECT start, hop, v[1] AS src, v[2] AS edge, tgt FROM (SELECT start, 1 AS hop, tgt, v FROM hop1 UNION ALL SELECT start, 2, tgt, v FROM hop2 UNION ALL SELECT start, 3, tgt, v FROM hop3)""", bounded=True)
def khop_directed(m):
    """Three-hop breadth-first tree from every customer"""
    starts = m.nodes.where(c("entity_type") == "Customer").select("id")
    return G.expand(walk_edges(m), starts, 3)


@query("khop_undirected", """SELECT n_nationkey AS nation, count(*) AS nodes FROM (SELECT DISTINCT n_nationkey, id FROM (
 SELECT n_nationkey, 'n'||CAST(n_nationkey AS VARCHAR) AS id FROM nation UNION ALL SELECT n_nationkey, 'r'||CAST(n_regionkey AS VARCHAR) FROM nation
 UNION ALL SELECT a.n_nationkey, 'n'||CAST(b.n_nationkey AS VARCHAR) FROM nation a JOIN nation b USING (n_regionkey)
 UNION ALL SELECT c_nationkey, 'c'||CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT s_nationkey, 's'||CAST(s_suppkey AS VARCHAR) FROM supplier
 UNION ALL SELECT s_nationkey, 'p'||CAST(l_partkey AS VARCHAR) FROM lineitem JOIN supplier ON l_suppkey=s_suppkey)) GROUP BY 1""", bounded=True)
def khop_undirected(m):
    """Nodes within two undirected hops of every nation"""
    seen, _ = G.surroundings(m.edges, nations(m), 2)
    return seen.groupBy(F.substring("start", 2, 9).cast("int").alias("nation")).agg(F.count(F.lit(1)).alias("nodes"))


@query("neighbors", "SELECT DISTINCT 'n' || CAST(k AS VARCHAR) AS id, x AS neighbor FROM (SELECT n_nationkey AS k, 'r'||CAST(n_regionkey AS VARCHAR) AS x FROM nation UNION ALL SELECT c_nationkey, 'c'||CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT s_nationkey, 's'||CAST(s_suppkey AS VARCHAR) FROM supplier)")
def neighbors(m):
    """Neighbours of every nation in both directions"""
    return G.neighbors(m.edges, nations(m), "both")


@query("edges_between", "SELECT id, relation_type FROM gedges WHERE from_id='n1' AND to_id IN (SELECT 'r'||CAST(r_regionkey AS VARCHAR) FROM region)")
def edges_between(m):
    """Edges between a node and the regions"""
    regions = m.nodes.where(c("entity_type") == "Region").select(c("id").alias("to_id"))
    return m.edges.where(c("from_id") == "n1").join(regions, "to_id", "left_semi").select("id", "relation_type")


@query("ego_graph", """SELECT start, count(*) AS edges FROM (SELECT DISTINCT start, edge FROM (
 SELECT 's'||CAST(s_suppkey AS VARCHAR) AS start, 'LOCATED_IN:s'||CAST(s_suppkey AS VARCHAR)||':n'||CAST(s_nationkey AS VARCHAR) AS edge FROM supplier
 UNION ALL SELECT from_id, id FROM gedges WHERE relation_type='SUPPLIES'
 UNION ALL SELECT 's'||CAST(s_suppkey AS VARCHAR), 'IN_REGION:n'||CAST(n_nationkey AS VARCHAR)||':r'||CAST(n_regionkey AS VARCHAR) FROM supplier JOIN nation ON n_nationkey=s_nationkey)) GROUP BY 1""", bounded=True)
def ego_graph(m):
    """Size of every supplier's two-hop view"""
    return G.ego_graph(m.edges, suppliers(m)).groupBy("start").agg(F.count(F.lit(1)).alias("edges"))


@query("induced_subgraph", "WITH h AS (SELECT id FROM gnodes ORDER BY id LIMIT 2000) SELECT id FROM gedges WHERE from_id IN (SELECT id FROM h) AND to_id IN (SELECT id FROM h)")
def induced_subgraph(m):
    """Edges among the first nodes by id"""
    return G.induced(m.nodes, m.edges, 2000)[1].select("id")


@query("graph_stats", """SELECT 'type' AS kind, entity_type AS name, count(*) AS total FROM gnodes GROUP BY 2 UNION ALL SELECT 'domain', domain, count(*) FROM gnodes GROUP BY 2
 UNION ALL SELECT 'nodes', 'all', count(*) FROM gnodes UNION ALL SELECT 'edges', 'all', count(*) FROM gedges""")
def graph_stats(m):
    """Node and edge counts per type and domain"""
    return G.stats(m.nodes, m.edges)


@query("search_partial", "SELECT id, name AS canonical_name FROM gnodes WHERE contains(lower(name),'ring') ORDER BY id LIMIT 20")
def search_partial(m):
    """Substring search in id order"""
    return G.search(m.nodes, "Ring", 20).select("id", "canonical_name")


@query("search_conf", "SELECT id, name AS canonical_name, R4(confidence) AS confidence FROM gnodes WHERE contains(lower(name),'ring') ORDER BY confidence DESC, id LIMIT 15")
def search_conf(m):
    """Substring search by confidence"""
    return G.search(m.nodes, "ring", 15, by_confidence=True).select("id", "canonical_name", rnd(c("confidence"), 4).alias("confidence"))


@query("keyword_search", "SELECT id, score FROM (SELECT id, CAST(contains(b,'red') AS INTEGER)+CAST(contains(b,'widget') AS INTEGER)+CAST(contains(b,'economy') AS INTEGER) AS score FROM (SELECT id, lower(name||' '||entity_type||' '||vals) AS b FROM gnodes)) WHERE score>0 ORDER BY score DESC, id LIMIT 20")
def keyword_search(m):
    """Nodes by number of tags found"""
    return G.keyword_search(m.nodes, ["Red", "widget", "ECONOMY"]).select("id", "score")


fragment("emb", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings")
_COS = "list_dot_product(a.v,q.v)/(sqrt(list_dot_product(a.v,a.v))*sqrt(list_dot_product(q.v,q.v)))"


_ASKED = "(SELECT * FROM emb WHERE vec_id%20=0)"


def asked_vectors(m):
    return m.embeddings.where("vec_id % 20 = 0").select(c("vec_id").alias("query_id"), "embedding")


def best_sql(k, floor=""):
    return f"SELECT query_id, vec_id, R5(s) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM (SELECT q.vec_id AS query_id, a.vec_id, {_COS} AS s FROM emb a, {_ASKED} q) {floor}) WHERE r<={k}"


@query("vector_topk", best_sql(20, "WHERE s>=0.35"))
def vector_topk(m):
    """Cosine search with threshold .35"""
    return G.vector_search(m.embeddings, asked_vectors(m), 20, 0.35).select("query_id", "vec_id", rnd(c("score"), 5).alias("score"))


@query("vector_knn_batch", best_sql(10))
def vector_knn_batch(m):
    """Ten nearest vectors of every query in a batch"""
    return G.vector_search(m.embeddings, asked_vectors(m), 10, eps=1e-9).select("query_id", "vec_id", rnd(c("score"), 5).alias("score"))


@query("topk_threshold", best_sql(5, "WHERE s>=0.35"))
def topk_threshold(m):
    """Threshold and top-k together"""
    return G.vector_search(m.embeddings, asked_vectors(m), 5, 0.35).select("query_id", "vec_id", rnd(c("score"), 5).alias("score"))


@query("vector_cells", best_sql(20, "WHERE s>=0.35"))
def vector_cells(m):
    """Cosine search with threshold .35 over a cell index"""
    index = V.build(m.embeddings, 64)
    return V.search(index, asked_vectors(m), 20, 0.35).select("query_id", "vec_id", rnd(c("score"), 5).alias("score"))


@query("embed_backlog", "SELECT id, (row_number() OVER (ORDER BY id) - 1)//64 AS batch FROM gnodes WHERE entity_type<>'Part'")
def embed_backlog(m):
    """Nodes without a vector in full batches of 64"""
    done = m.nodes.where(c("entity_type") == "Part").select("id")
    return G.embed_backlog(m.nodes, done, 64).select("id", "batch")


@query("score_batches", "SELECT id, (row_number() OVER (ORDER BY id) - 1)//20 AS batch FROM gedges")
def score_batches(m):
    """Edges in full scorer batches of 20"""
    return G.batches(m.edges, "id", 20).select("id", "batch")


@query("typed_neighbors", "SELECT from_id, to_id, strftime(created_at,'%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY created_at DESC, to_id) AS r FROM gedges WHERE relation_type='SUPPLIES') WHERE r<=10", bounded=True)
def typed_neighbors(m):
    """Ten newest parts of every supplier"""
    d = G.typed_neighbors(m.edges, m.nodes, "SUPPLIES", 10)
    return d.select("from_id", "to_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("connections", f"""SELECT start, hop, src_name, tgt_name, relation_type, weight FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hop, src, tgt) AS r FROM (
 SELECT x.start, x.hop, x.v[1] AS src, x.tgt, a.name AS src_name, b.name AS tgt_name, g.relation_type, R3({EFF}) AS weight FROM (
  SELECT start, 1 AS hop, tgt, v FROM h1 UNION ALL SELECT start, 2, tgt, v FROM h2) x JOIN gedges g ON g.id=x.v[2] JOIN gnodes a ON a.id=x.v[1] JOIN gnodes b ON b.id=x.tgt)) WHERE r<=30""", bounded=True)
def connections(m):
    """Readable two-hop connections of every supplier"""
    d = G.connections(m.edges, m.nodes, suppliers(m), 2, now())
    return d.select("start", "hop", "src_name", "tgt_name", "relation_type", "weight")


fragment("h1", "SELECT from_id AS start, to_id AS tgt, min(row(from_id, id)) AS v FROM gedges WHERE from_id LIKE 's%' GROUP BY 1,2")
fragment("h2", "SELECT h.start, g.to_id AS tgt, min(row(g.from_id, g.id)) AS v FROM h1 h JOIN gedges g ON g.from_id=h.tgt GROUP BY 1,2")


@query("company_upsert", """SELECT 'new sector' AS kind, lower(c_mktsegment) AS name, 1::BIGINT AS total FROM customer WHERE c_mktsegment<>'BUILDING' GROUP BY 2 UNION ALL SELECT 'in sector', lower(c_mktsegment), count(*) FROM customer GROUP BY 2""")
def company_upsert(m):
    """Sector nodes created once, every company linked"""
    co = m.table("customer").select(F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("id"), c("c_mktsegment").alias("sector"))
    known = co.where(c("sector") == "BUILDING").limit(1).select(F.lit("sec").alias("id"), F.lit("Sector").alias("entity_type"), F.lit("Building").alias("canonical_name"))
    new, edges = G.upsert_sectors(co, known)
    per = edges.join(co.select(c("id").alias("from_id"), F.lower("sector").alias("name")), "from_id").groupBy("name").agg(F.count(F.lit(1)).alias("total"))
    return (new.select(F.lit("new sector").alias("kind"), F.lower("canonical_name").alias("name"), F.lit(1).cast("bigint").alias("total"))
            .union(per.select(F.lit("in sector"), "name", "total")))


@query("macro_upsert", """SELECT CASE WHEN hash_known THEN 'known-' || symbol ELSE 'new' END AS id, symbol || sfx AS name, value, CASE WHEN sfx='/USD' THEN 'INR' ELSE 'points' END AS unit FROM (
 SELECT symbol, arg_max(close, ts) AS value, symbol<'error' AS hash_known, CASE WHEN symbol>'s' THEN '/USD' ELSE '' END AS sfx FROM hbars GROUP BY symbol)""")
def macro_upsert(m):
    """Newest macro values by name, ids kept when known"""
    name = F.concat("symbol", F.when(c("symbol") > "s", "/USD").otherwise(""))
    v = m.hourly_bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("value")).select(name.alias("name"), "value", "symbol")
    known = v.where(c("symbol") < "error").select("name", F.concat(F.lit("known-"), "symbol").alias("id"))
    d = G.upsert_macro(v.select("name", "value"), known)
    return d.withColumn("id", F.when(c("id").startswith("known-"), c("id")).otherwise("new"))


@query("node_builders", """SELECT count(*) AS nodes, count(DISTINCT k) AS ids, count(DISTINCT sector) AS sectors FROM (SELECT c_custkey AS k, c_mktsegment AS sector FROM customer)""")
def node_builders(m):
    """Typed node rows with deterministic ids"""
    d = G.make_nodes(m.table("customer"), "Company", c("c_name"), [c("c_custkey").cast("string")], ticker=F.concat(F.lit("C"), c("c_custkey").cast("string")),
                     sector=c("c_mktsegment"), industry=F.lit(None).cast("string"), exchange=F.lit("NSE"))
    return d.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("id").alias("ids"), F.countDistinct(c("attributes")["sector"]).alias("sectors"))


@query("join_edge_node", "SELECT g.id, t.name AS target FROM gedges g JOIN gnodes t ON t.id=g.to_id WHERE t.entity_type='Part'")
def join_edge_node(m):
    """Edges to nodes of one type"""
    t = m.nodes.where(c("entity_type") == "Part").select(c("id").alias("to_id"), c("canonical_name").alias("target"))
    return m.edges.join(t, "to_id").select("id", "target")


@query("array_set_union", "SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY 1")
def array_set_union(m):
    """Union of sets per key"""
    d = m.table("conversations").groupBy("conv_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("role"))))).alias("roles"))
    return d.select("conv_id", F.array_join("roles", ",").alias("roles"))


# ── knowledge graph ─────────────────────────────────────────────────────────────────
TYPES = ["Organization", "Person", "ClimateEvent", "Country", "Spaceship"]
ALLOWED = {"Organization": ["sector", "country"], "Person": ["title"]}


def extractions(m):
    """Two entities and four relations per message, shaped like extractor output."""
    k, t = c("conv_id"), c("turn")
    word = F.split_part("text", F.lit(" "), F.lit(1))
    suffix = lookup(k % 3, {0: " Ltd", 1: " Inc."}, "")
    first = F.concat(word, suffix)
    unit = F.concat(F.lit("Unit "), (k % 20).cast("string"))
    nxt = F.concat(F.lit("Unit "), ((k + 1) % 20).cast("string"))
    kind = lookup(t % 5, dict(enumerate(TYPES)))
    ent = lambda ty, name, al, at, cf: F.struct(ty.alias("entity_type"), name.alias("canonical_name"), al.alias("aliases"), at.alias("attributes"), cf.alias("confidence"))
    rel = lambda ty, a, b, w: F.struct(F.lit(ty).alias("relation_type"), a.alias("from_entity"), b.alias("to_entity"), w.alias("weight"))
    return m.table("conversations").select(
        F.concat(F.lit("conv:"), k.cast("string"), F.lit(":"), t.cast("string")).alias("source_url"),
        F.array(ent(kind, first, F.array(word), F.create_map(F.lit("sector"), c("role"), F.lit("junk"), F.lit("x")), F.when(t % 2 == 0, 0.9)),
                ent(F.lit("Organization"), unit, F.array().cast("array<string>"), F.create_map(F.lit("country"), c("role")), F.lit(0.7))).alias("entities"),
        F.array(rel("PARTNERED_WITH", first, unit, F.lit(None).cast("double")), rel("MADE_UP", first, unit, F.lit(1.0)), rel("COMPETES_WITH", unit, nxt, F.lit(0.5)),
                rel("ACQUIRED", unit, unit, F.lit(0.9))).alias("relations"))


fragment("conv_x", """SELECT conv_id, turn, role, 'conv:'||CAST(conv_id AS VARCHAR)||':'||CAST(turn AS VARCHAR) AS url, split_part(text,' ',1) AS w, split_part(text,' ',1) || CASE conv_id%3 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' Inc.' ELSE '' END AS nm,
 'Unit '||CAST(conv_id%20 AS VARCHAR) AS unit, 'Unit '||CAST((conv_id+1)%20 AS VARCHAR) AS nxt, CASE turn%5 WHEN 0 THEN 'Organization' WHEN 1 THEN 'Person' WHEN 2 THEN 'ClimateEvent' WHEN 3 THEN 'Country' ELSE 'Spaceship' END AS ty FROM conversations""")
fragment("ents", """SELECT url, trim(nm) AS name, ty, CASE ty WHEN 'Organization' THEN 'sector' WHEN 'Person' THEN '' ELSE 'junk,sector' END AS keys, CASE WHEN turn%2=0 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence, w AS alias, role FROM conv_x WHERE ty<>'Spaceship' AND trim(nm)<>''
UNION ALL SELECT url, unit, 'Organization', 'country', 0.7, NULL, role FROM conv_x""")


def admitted(m):
    return K.admit_entities(extractions(m), K.ontology_types(m.spark), K.allowed_attributes(m.spark, ALLOWED))


@query("admit_entities", "SELECT url AS source_url, name AS canonical_name, ty AS entity_type, keys, confidence FROM ents")
def admit_entities(m):
    """Validated entities of every extraction"""
    return admitted(m).select("source_url", "canonical_name", "entity_type", F.array_join(F.array_sort(F.map_keys("attributes")), ",").alias("keys"), "confidence")


NN = NORM.format("name")


@query("merge_entities", f"""SELECT ty AS entity_type, norm AS norm_name, count(DISTINCT url) AS sources, max(confidence) AS confidence, CASE WHEN ty='Organization' THEN arg_min(role, url) FILTER (keys='sector') END AS sector FROM (SELECT *, {NN} AS norm FROM ents) WHERE norm<>'' GROUP BY ty, norm""")
def merge_entities(m):
    """Entities of one normalised name merged into one row"""
    d = admitted(m).withColumn("norm_name", X.normalize_name(c("canonical_name"))).where(c("norm_name") != "").withColumn("sources", F.array("source_url"))
    g = K.merge_tables(d, ["entity_type", "norm_name"], "source_url")
    count = g.sources.groupBy(*g.key).agg(F.count(F.lit(1)).alias("sources"))
    sector = g.attributes.where((c("field") == "sector") & (c("entity_type") == "Organization")).select(*g.key, c("value").alias("sector"))
    return g.entities.join(count, g.key).join(sector, g.key, "left").select(*g.key, "sources", "confidence", "sector")


@query("admit_relations", """SELECT relation_type, from_name, to_name, max(weight) AS weight, count(DISTINCT url) AS sources FROM (
 SELECT 'PARTNERED_WITH' AS relation_type, nm AS from_name, unit AS to_name, CAST(0.8 AS DOUBLE) AS weight, url FROM conv_x WHERE ty<>'Spaceship' AND trim(nm)<>'' AND nm<>unit
 UNION ALL SELECT 'COMPETES_WITH', unit, nxt, 0.5, url FROM conv_x WHERE nxt IN (SELECT unit FROM conv_x)) GROUP BY 1,2,3""")
def admit_relations(m):
    """Edges of every extraction with both ends resolved"""
    ent = admitted(m)
    local = ent.select("source_url", c("canonical_name").alias("name"), c("canonical_name").alias("id")).distinct()
    resolver = ent.where(c("canonical_name").startswith("Unit ")).select(c("canonical_name").alias("name"), c("canonical_name").alias("id")).distinct()
    d = K.admit_relations(extractions(m), K.ontology_relations(m.spark), local, resolver)
    return d.select("relation_type", c("from_id").alias("from_name"), c("to_id").alias("to_name"), "weight", F.size("sources").cast("bigint").alias("sources"))


@query("entity_upsert", f"""SELECT entity_type, norm_name, count(*) AS copies, R4(max(confidence)) AS confidence, min(id) AS id FROM (SELECT id, entity_type, confidence, {NN} AS norm_name FROM gnodes) GROUP BY 1,2""")
def entity_upsert(m):
    """Add-or-merge by exact normalised name and type"""
    d = m.nodes.withColumn("norm_name", X.normalize_name(c("canonical_name"))).withColumn("sources", F.array("id"))
    g = K.merge_tables(d, ["entity_type", "norm_name"], "id")
    count = g.sources.groupBy(*g.key).agg(F.count(F.lit(1)).alias("copies"))
    return g.entities.join(count, g.key).select(*g.key, "copies", rnd(c("confidence"), 4).alias("confidence"), c("first").alias("id"))


@query("entity_provenance", f"""SELECT entity_type, norm_name, 'source' AS kind, url AS value FROM (SELECT ty AS entity_type, {NN} AS norm_name, url FROM ents) WHERE norm_name<>'' GROUP BY ALL
UNION ALL SELECT entity_type, norm_name, 'name', value FROM (SELECT ty AS entity_type, {NN} AS norm_name, unnest([name, alias]) AS value FROM ents) WHERE norm_name<>'' AND value<>'' GROUP BY ALL""")
def entity_provenance(m):
    """Every source and every name of every merged entity"""
    d = admitted(m).withColumn("norm_name", X.normalize_name(c("canonical_name"))).where(c("norm_name") != "").withColumn("sources", F.array("source_url"))
    g = K.merge_tables(d, ["entity_type", "norm_name"], "source_url")
    return (g.sources.select(*g.key, F.lit("source").alias("kind"), c("source").alias("value"))
            .union(g.names.select(*g.key, F.lit("name"), "name")))


@query("name_index", f"SELECT {NN} AS norm_name, id FROM gnodes")
def name_index(m):
    """Normalised name of every node"""
    return K.name_index(m.nodes).select("norm_name", "id")


_Q = "CASE p_partkey%5 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' Ltd.' WHEN 2 THEN split_part(p_name,' ',2) || 's' WHEN 3 THEN split_part(p_name,' ',2) || ' ' || split_part(p_name,' ',1) ELSE 'new ' || p_name || ' deluxe' END"
fragment("ask", f"SELECT DISTINCT name, {NN} AS norm FROM (SELECT {_Q} AS name FROM part)")
fragment("known", f"SELECT text, string_split(text,' ') AS t, min(id) AS id FROM (SELECT {NN} AS text, id FROM gnodes WHERE entity_type='Part') GROUP BY text")
fragment("tiers", f"""SELECT a.name, 1 AS tier, k.id, CAST(0 AS DOUBLE) AS s FROM ask a JOIN known k ON k.text=a.norm
UNION ALL SELECT a.name, 2, min(k.id), 0 FROM (SELECT name, {KEY.format('name')} AS key FROM ask) a JOIN known k ON k.text=a.key GROUP BY a.name
UNION ALL SELECT a.name, 3, min(k.id), 0 FROM ask a JOIN known k ON contains(a.norm, k.text) OR contains(k.text, a.norm) GROUP BY a.name
UNION ALL SELECT a.name, 4, k.id, len(list_intersect(string_split(a.norm,' '), k.t))/CAST(len(list_distinct(list_concat(string_split(a.norm,' '), k.t))) AS DOUBLE) AS s FROM ask a JOIN known k ON len(list_intersect(string_split(a.norm,' '), k.t))/CAST(len(list_distinct(list_concat(string_split(a.norm,' '), k.t))) AS DOUBLE) >= 0.75""")


@query("resolve_tiers", "SELECT name, tier, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, s DESC, id) AS r FROM tiers) WHERE r=1")
def resolve_tiers(m):
    """Best existing part for every spelling"""
    asked = m.table("part").select(e(_Q).alias("name"), F.lit("Part").alias("entity_type"))
    return K.resolve(asked, m.nodes.where(c("entity_type") == "Part")).select("name", "tier", "id")


@query("resolve_two_tiers", "SELECT name, tier, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, id) AS r FROM tiers WHERE tier IN (1,3)) WHERE r=1")
def resolve_two_tiers(m):
    """Exact name, else containment"""
    asked = m.table("part").select(e(_Q).alias("name"), F.lit("Part").alias("entity_type"))
    return K.resolve(asked, m.nodes.where(c("entity_type") == "Part"), tiers=(1, 3)).select("name", "tier", "id")


_QA = "CASE length(canonical_name)%4 WHEN 0 THEN upper(canonical_name) WHEN 1 THEN canonical_name || ' Ltd.' WHEN 2 THEN substr(canonical_name,3) ELSE 'new ' || canonical_name || ' deluxe' END"
fragment("ask_all", f"SELECT DISTINCT entity_type, name, {NN} AS norm FROM (SELECT entity_type, {_QA.replace('canonical_name', 'name')} AS name FROM gnodes)")
fragment("known_all", f"SELECT entity_type, {NN} AS text, min(id) AS id FROM gnodes GROUP BY 1, 2")


@query("resolve_contained", """SELECT a.entity_type, a.name, CASE WHEN min(k.id) FILTER (k.text=a.norm) IS NOT NULL THEN 1 ELSE 3 END AS tier, coalesce(min(k.id) FILTER (k.text=a.norm), min(k.id)) AS id
 FROM ask_all a JOIN known_all k ON k.entity_type=a.entity_type AND (contains(a.norm, k.text) OR contains(k.text, a.norm)) WHERE a.norm<>'' AND k.text<>'' GROUP BY a.entity_type, a.name""")
def resolve_contained(m):
    """Exact name, else containment, for spellings of the nodes of every type"""
    asked = m.nodes.select(e(_QA).alias("name"), "entity_type")
    return K.resolve(asked, m.nodes, tiers=(1, 3)).select("entity_type", "name", "tier", "id")


fragment("deg", "SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM gedges UNION ALL SELECT to_id FROM gedges) GROUP BY 1")
fragment("dup", f"""SELECT id, entity_type, first_value(id) OVER (PARTITION BY entity_type, key ORDER BY confidence + CAST(0.001 AS DOUBLE)*coalesce(degree,0) DESC, id) AS survivor
FROM (SELECT n.id, entity_type, confidence, degree, array_to_string(list_sort(list_distinct(string_split({NN},' '))),' ') AS key FROM gnodes n LEFT JOIN deg USING (id))""")


@query("dedup_clusters", "SELECT id, survivor FROM dup")
def dedup_clusters(m):
    """Survivor of every node after fuzzy dedup"""
    return K.duplicate_map(m.nodes, m.edges).select("id", "survivor")


@query("dedup_rewrite", """SELECT a.survivor AS from_id, b.survivor AS to_id, g.relation_type, R6(arg_min(g.weight, row(-g.confidence, g.id))) AS weight FROM gedges g JOIN dup a ON a.id=g.from_id JOIN dup b ON b.id=g.to_id WHERE a.survivor<>b.survivor GROUP BY 1,2,3""")
def dedup_rewrite(m):
    """Edges redirected to survivors and collapsed"""
    _, edges = K.rewrite(m.nodes, m.edges, K.duplicate_map(m.nodes, m.edges))
    return edges.select("from_id", "to_id", "relation_type", rnd(c("weight"), 6).alias("weight"))


fragment("linked", "SELECT from_id AS a, to_id AS b FROM gedges UNION SELECT to_id, from_id FROM gedges")
_START = "CAST('0x' || substr(md5(''),1,12) AS BIGINT)"
fragment("pnum", "SELECT id, domain, row_number() OVER (ORDER BY domain, md5(id), id) - 1 AS g FROM gnodes")
fragment("pblk", """SELECT *, n*later AS size, CAST(sum(n*later) OVER (ORDER BY a0) AS BIGINT) - n*later AS off FROM (
 SELECT min(g) AS a0, count(*) AS n, (SELECT count(*) FROM gnodes) - min(g) - count(*) AS later FROM pnum GROUP BY domain) WHERE later>0""")
fragment("ptot", "SELECT whole, min(k) AS step FROM (SELECT whole, unnest(range(whole*618//1000+1, whole*618//1000+400)) AS k FROM (SELECT CAST(sum(size) AS BIGINT) AS whole FROM pblk)) WHERE gcd(k,whole)=1 GROUP BY whole")
fragment("pwalk", f"SELECT t, CAST(({_START}%whole + CAST(t AS HUGEINT)*step) % whole AS BIGINT) AS p FROM ptot, (SELECT unnest(range(0, 5000)) AS t) WHERE t<whole")


@query("pairs_affinity", """SELECT least(x.id,y.id) AS a, greatest(x.id,y.id) AS b FROM pwalk JOIN pblk ON p>=off AND p<off+size JOIN pnum x ON x.g=a0+(p-off)//later JOIN pnum y ON y.g=a0+n+(p-off)%later
 LEFT JOIN linked l ON l.a=x.id AND l.b=y.id WHERE l.a IS NULL ORDER BY t LIMIT 40""")
def pairs_affinity(m):
    """Forty unlinked pairs of different domains"""
    return K.affinity_pairs(m.nodes, m.edges, 40)


SCHEMAS = [("goods-supply", "goods", "supply", ["Part"], ["Supplier"]), ("supply-geo", "supply", "geography", None, ["Nation"]), ("geo-demand", "geography", "demand", None, None)]


def pair_schemas(m):
    return m.spark.createDataFrame(SCHEMAS, "schema string, from_domain string, to_domain string, from_types array<string>, to_types array<string>")


fragment("sp_side", """SELECT *, row_number() OVER (ORDER BY schema, side, md5(id), id) - 1 AS g FROM (
 SELECT 'goods-supply' AS schema, 0 AS side, id FROM gnodes WHERE entity_type='Part' UNION ALL SELECT 'goods-supply', 1, id FROM gnodes WHERE entity_type='Supplier'
 UNION ALL SELECT 'supply-geo', 0, id FROM gnodes WHERE domain='supply' UNION ALL SELECT 'supply-geo', 1, id FROM gnodes WHERE entity_type='Nation'
 UNION ALL SELECT 'geo-demand', 0, id FROM gnodes WHERE domain='geography' UNION ALL SELECT 'geo-demand', 1, id FROM gnodes WHERE domain='demand')""")
fragment("sp_blk", """SELECT schema, a0, b0, nb, na*nb AS whole FROM (SELECT schema, min(g) FILTER (side=0) AS a0, min(g) FILTER (side=1) AS b0, count(*) FILTER (side=0) AS na, count(*) FILTER (side=1) AS nb FROM sp_side GROUP BY schema)""")
fragment("sp_walk", f"""SELECT schema, a0, b0, nb, t, CAST(({_START}%whole + CAST(t AS HUGEINT)*step) % whole AS BIGINT) AS p FROM sp_blk JOIN
 (SELECT schema, min(k) AS step FROM (SELECT schema, whole, unnest(range(whole*618//1000+1, whole*618//1000+400)) AS k FROM sp_blk) WHERE gcd(k,whole)=1 GROUP BY schema) USING (schema), (SELECT unnest(range(0, 5000)) AS t) WHERE t<whole""")


@query("pairs_schema", """SELECT schema, a, b FROM (SELECT w.schema, x.id AS a, y.id AS b, row_number() OVER (PARTITION BY w.schema ORDER BY t) AS r FROM sp_walk w JOIN sp_side x ON x.g=a0+p//nb JOIN sp_side y ON y.g=b0+p%nb
 LEFT JOIN linked l ON l.a=x.id AND l.b=y.id WHERE l.a IS NULL AND x.id<>y.id) WHERE r<=30""")
def pairs_schema(m):
    """Thirty unlinked pairs per schema row"""
    return K.schema_pairs(m.nodes, m.edges, pair_schemas(m), 30).select("schema", "a", "b")


fragment("cand", "SELECT n_nationkey, 's'||CAST(s_suppkey AS VARCHAR) AS a, 'c'||CAST(c_custkey AS VARCHAR) AS b, c_custkey FROM supplier JOIN customer ON c_custkey%(SELECT n FROM nsup)=s_suppkey JOIN nation ON n_nationkey=s_nationkey")


def candidate_pairs(m):
    """Supplier–customer pairs, one per customer."""
    s = m.table("supplier").select("s_suppkey", "s_nationkey")
    d = m.table("customer").withColumn("s_suppkey", c("c_custkey") % m.symbol_count).join(s, "s_suppkey")
    return d.select(F.concat(F.lit("s"), c("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("b"), "c_custkey")


@query("join_pair_anti", "SELECT a, b FROM cand WHERE c_custkey%4<>0")
def join_pair_anti(m):
    """Pairs without an edge in either direction"""
    d = candidate_pairs(m)
    half = c("c_custkey") % 8 == 0
    e_ = d.where(c("c_custkey") % 4 == 0).select(F.when(half, c("a")).otherwise(c("b")).alias("from_id"), F.when(half, c("b")).otherwise(c("a")).alias("to_id"))
    return K.unlinked(d.select("a", "b"), e_)


def batched(m):
    """Pairs in batches of twelve with their position, and a text answer per batch."""
    d = candidate_pairs(m).select("a", "b", "c_custkey", F.floor(c("c_custkey") / 12.0).alias("batch"), (c("c_custkey") % 12).cast("int").alias("pos"))
    return d


@query("admit_affinity", "SELECT a AS from_id, b AS to_id, (c_custkey%10)/CAST(10 AS DOUBLE) AS weight FROM cand WHERE c_custkey%7<>0 AND (c_custkey%10)/CAST(10 AS DOUBLE)>=0.15")
def admit_affinity(m):
    """Score lists admitted as affinity edges"""
    d = batched(m)
    item = F.when(c("c_custkey") % 7 == 0, F.lit('"n/a"')).otherwise(((c("c_custkey") % 10) / 10).cast("string"))
    ans = d.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("s")))).alias("x"))
    ans = ans.select("batch", F.concat(F.lit("Scores: ["), F.array_join(F.transform("x", lambda v: v["s"]), ", "), F.lit("] done")).alias("answer"))
    return K.admit_affinity(d, ans).select("from_id", "to_id", "weight")


@query("admit_typed", "SELECT a AS from_id, b AS to_id, 'EXPOSED_TO' AS relation_type, (c_custkey%10)/CAST(10 AS DOUBLE) AS confidence FROM cand WHERE c_custkey%3=0 AND (c_custkey%10)/CAST(10 AS DOUBLE)>=0.6")
def admit_typed(m):
    """Typed answers admitted when known and confident"""
    d = batched(m).withColumn("schema", F.lit("supply-demand"))
    rel = lookup(c("c_custkey") % 3, {0: "EXPOSED_TO", 1: "INVENTED"})
    ans = d.groupBy("batch").agg(F.to_json(F.collect_list(F.struct(c("pos").alias("pair"), rel.alias("relation"), ((c("c_custkey") % 10) / 10).alias("confidence")))).alias("answer"))
    vocab = m.spark.createDataFrame([("supply-demand", "EXPOSED_TO"), ("supply-demand", "OPERATES_IN")], "schema string, relation string")
    return K.admit_typed(d, ans, vocab).select("from_id", "to_id", "relation_type", "confidence")


@query("edge_labels", "SELECT 'a' || CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey%3=0 THEN 'known' WHEN c_custkey%3=1 THEN 'label ' || CAST(c_custkey%5 AS VARCHAR) END AS label FROM cand")
def edge_labels(m):
    """Labels written to edges that had none"""
    k = c("c_custkey")
    d = candidate_pairs(m).select(F.concat(F.lit("a"), k.cast("string")).alias("id"), F.lit("LLM_AFFINITY").alias("relation_type"), "c_custkey",
                                  F.when(k % 3 == 0, F.create_map(F.lit("inferred_relation"), F.lit("known"))).otherwise(F.create_map().cast("map<string,string>")).alias("attributes"))
    lab = d.where(k % 3 != 2).select("id", F.concat(F.lit("label "), (k % 5).cast("string")).alias("label"))
    return K.label_edges(d, lab).select("id", F.element_at("attributes", "inferred_relation").alias("label"))


def hash_scorer(pairs):
    """Deterministic stand-in for a model: weight from the pair's hash."""
    h = F.conv(F.substring(F.md5(F.concat("b", F.lit("~"), "a")), 9, 4), 16, 10).cast("double")
    return pairs.withColumn("weight", h / 65535.0)


def typed_hash_scorer(pairs):
    """Deterministic stand-in for a typed model answer."""
    return hash_scorer(pairs).select("schema", "a", "b", F.lit("EXPOSED_TO").alias("relation"), c("weight").alias("confidence"))


def build_schemas(m):
    return m.spark.createDataFrame([("corporate-geo", "corporate", "geopolitics", ["Organization"], ["Country"])],
                                   "schema string, from_domain string, to_domain string, from_types array<string>, to_types array<string>")


@query("kg_build")
def kg_build(m):
    """Full build from extractions: admit, resolve, merge, dedup, pair, score, admit"""
    empty = m.nodes.select("id", "entity_type", "domain", "canonical_name", "aliases", "attributes", "sources", "confidence").where(c("entity_type").isin("Region", "Nation"))
    vocab = m.spark.createDataFrame([("corporate-geo", "EXPOSED_TO")], "schema string, relation string")
    edges = m.edges.where(c("relation_type") == "IN_REGION").withColumn("sources", F.array(F.lit("nation")))
    nodes, links = K.build(extractions(m), empty, edges, K.ontology_types(m.spark), K.ontology_relations(m.spark), K.allowed_attributes(m.spark, ALLOWED), hash_scorer,
                           build_schemas(m), typed_hash_scorer, vocab, lambda d: d.select("id", F.lit("moves with").alias("label")))
    labelled = links.where(F.element_at("attributes", "inferred_relation").isNotNull()).groupBy("relation_type").agg(F.count(F.lit(1)).alias("total"))
    return G.stats(nodes, links).union(labelled.select(F.lit("labelled"), "relation_type", "total"))
