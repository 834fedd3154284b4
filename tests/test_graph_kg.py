"""Graph and knowledge-graph operators on literal cases and against brute force."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from marketloom.functions import scalars as X
from marketloom.operators import graph as G, kg as K
from marketloom.operators.components import components
from marketloom.sources.store import read_bars, write_bars


def nodes_of(spark, names, kind="T"):
    return spark.createDataFrame([(f"n{k:03d}", kind, "d", n, [], {"a": str(k)}, ["s"], 0.5) for k, n in enumerate(names)],
                                 "id string, entity_type string, domain string, canonical_name string, aliases array<string>, attributes map<string,string>, sources array<string>, confidence double")


def edges_of(spark, rows):
    return spark.createDataFrame([(f"e{k}", "R", a, b, 1.0, float(conf), [f"s{k}"]) for k, (a, b, conf) in enumerate(rows)],
                                 "id string, relation_type string, from_id string, to_id string, weight double, confidence double, sources array<string>")


def test_best_edges(spark):
    n = nodes_of(spark, ["a", "b"])
    e = edges_of(spark, [("n000", "n001", 0.5), ("n000", "n001", 0.5), ("n000", "n001", 0.4), ("n000", "zz", 0.9), ("n001", "n001", 0.1)])
    got = {(r.from_id, r.to_id): (r.id, r.sources) for r in G.best_edges(e, n).collect()}
    assert got == {("n000", "n001"): ("e0", ["s0", "s1", "s2"]), ("n001", "n001"): ("e4", ["s4"])}


def test_provenance_is_rows(spark):
    """Ties keep the earlier edge, an unknown confidence wins as before, null sources vanish."""
    e = spark.createDataFrame([("e2", "R", "a", "b", 1.0, 0.5, ["y", None]), ("e1", "R", "a", "b", 2.0, 0.5, ["x", "y"]), ("e3", "R", "a", "c", 3.0, 0.1, None),
                               ("e4", "R", "a", "c", 4.0, None, [])], "id string, relation_type string, from_id string, to_id string, weight double, confidence double, sources array<string>")
    assert sorted((r.to_id, r.id) for r in G.winning_edges(e).collect()) == [("b", "e1"), ("c", "e4")]
    assert sorted((r.to_id, r.source) for r in G.edge_sources(e).collect()) == [("b", "x"), ("b", "y")]
    assert {r.to_id: r.sources for r in G.best_edges(e).collect()} == {"b": ["x", "y"], "c": []}


def test_merged_entities_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice("pqr"), k, rng.choice(["N", "n", "Nn"]), rng.sample(["N", "o", "w", ""], rng.randint(0, 3)), {f: str(k) for f in rng.sample("fgh", rng.randint(0, 2))},
             rng.sample(["s", "t", "u"], rng.randint(0, 2)), rng.random(), rng.choice([None, f"d{k}"])) for k in range(60)]
    d = spark.createDataFrame(rows, "k string, rank int, canonical_name string, aliases array<string>, attributes map<string,string>, sources array<string>, confidence double, description string")
    got = {r.k: r for r in K.merge_rows(d.repartition(7), ["k"], "rank").collect()}
    for key in "pqr":
        mine = [r for r in rows if r[0] == key]
        fields = {}
        for r in mine:
            for f, v in r[4].items():
                fields.setdefault(f, v)
        names = {x for r in mine for x in [r[2], *r[3]] if x} - {mine[0][2]}
        want = (mine[0][2], sorted(names), fields, sorted({x for r in mine for x in r[5]}), max(r[6] for r in mine), next(r[7] for r in mine if r[7]))
        r = got[key]
        assert (r.canonical_name, r.aliases, r.attributes, r.sources, r.confidence, r.description) == want


def test_expand_revisits_start_once(spark):
    e = edges_of(spark, [("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("c", "c", 1), ("a", "b", 1)])
    s = spark.createDataFrame([("a",)], "id string")
    assert sorted((r.hop, r.tgt) for r in G.expand(e, s, 4).collect()) == [(1, "b"), (2, "a"), (2, "c")]
    assert sorted(r.tgt for r in G.expand(e, s, 2, exclude_start=True).collect()) == ["b", "c"]


def test_surroundings(spark):
    e = edges_of(spark, [("a", "b", 1), ("c", "b", 1), ("c", "d", 1)])
    seen, used = G.surroundings(e, spark.createDataFrame([("a",)], "id string"), 2)
    assert sorted(r.id for r in seen.collect()) == ["a", "b", "c"] and sorted(r.edge for r in used.collect()) == ["e0", "e1"]


@pytest.mark.parametrize("days,want", [(0, 1.0), (180, 0.5), (360, 0.25)])
def test_decay(spark, days, want):
    d = spark.sql(f"SELECT 1D AS weight, 1D AS confidence, TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' + INTERVAL {days} DAYS AS now")
    assert d.select(G.edge_weight(F.col("now")).alias("w")).first().w == pytest.approx(want)


def test_vector_search(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.35, 0.9367496997597597]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<double>")
    assert [r.vec_id for r in G.vector_search(v.repartition(3), q, 9, 0.3499).orderBy("rank").collect()] == [0, 2]
    assert [r.vec_id for r in G.vector_search(v, q, 9).orderBy("rank").collect()] == [0, 2, 1, 3]


def test_vector_search_takes_any_number_of_questions(spark, monkeypatch):
    monkeypatch.setattr(G, "QUERY_BLOCK", 7)
    monkeypatch.setattr(G, "VECTOR_BLOCK", 11)
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = spark.createDataFrame(rows[:40], "query_id long, embedding array<double>")
    got = {}
    for r in G.vector_search(v, q, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = [[x / sum(y * y for y in e) ** 0.5 for x in e] for _, e in rows]
    want = {k: sorted(range(60), key=lambda j: -sum(a * b for a, b in zip(unit[k], unit[j])))[:3] for k in range(40)}
    assert got == want


@pytest.mark.parametrize("buckets", [3, 8, 100])
def test_bar_store_reads_back_every_symbol(spark, walk, tmp_path, buckets):
    bars, pdf = walk
    write_bars(bars, str(tmp_path / "bars"), buckets)
    for symbol, want in pdf.groupby("symbol").size().items():
        assert read_bars(spark, str(tmp_path / "bars"), [symbol]).count() == want
    assert read_bars(spark, str(tmp_path / "bars")).count() == len(pdf)


WORDS = ["red", "ring", "small", "big", "anvil", "x", "ab", "abc", "bc", "steel"]


def random_names(seed, n, low=1, high=4):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))) for _ in range(n)]


def test_containment_equals_brute_force(spark):
    a, b = sorted(set(random_names(1, 60, 1, 2))) + ["", "e"], sorted(set(random_names(2, 60)))
    to = lambda xs: spark.createDataFrame([("T", x) for x in xs], "entity_type string, text string")
    got = {(r.needle, r.hay) for r in K.contained(to(a), to(b), ["entity_type"]).collect()}
    assert got == {(x, y) for x in a for y in b if x and x in y}


@pytest.mark.parametrize("group", [1, 4, 2000])
def test_containment_with_common_grams(spark, monkeypatch, group):
    """Three of four texts share a stem, needles are stems, their parts and longer names."""
    monkeypatch.setattr(K, "GRAM_GROUP", group)
    monkeypatch.setattr(K, "GRAM_SALTS", 3)
    texts = [f"customer {k:04d}" for k in range(90)] + [f"part {k}" for k in range(30)] + ["", "a", "customer", None]
    asked = ["customer", "custom", "c", "us", "ust", "mer 0", "customer 00", "customer 0042", "omer 0042 x", "", "zzz", "ztomer", None]
    hay = spark.createDataFrame([(k, t, f"{i:03d}") for k in "xy" for i, t in enumerate(texts)], "kind string, hay string, id string")
    needles = spark.createDataFrame([("x", t) for t in asked] + [("z", "customer")], "kind string, needle string")
    got = sorted((r.needle, r.id) for r in K.inside(needles, hay, ["kind"]).collect())
    assert got == sorted((n, f"{i:03d}") for n in asked if n for i, t in enumerate(texts) if t and n in t)
    turned = K.inside(needles.select("kind", "needle"), hay.where("hay like 'q%'"), ["kind"])
    assert turned.count() == 0


def test_common_grams_are_split(spark, monkeypatch):
    """A gram that all texts hold is dealt out: no key of the join holds a large part of them."""
    monkeypatch.setattr(K, "GRAM_GROUP", 50)
    hay = spark.range(3000).select(F.concat(F.lit("customer "), F.col("id").cast("string")).alias("hay"))
    h, _, found = K._dealt(hay.withColumn("g", F.explode(K._grams(F.col("hay"), [3]))), [])
    assert found and h.groupBy("g", "part").count().agg(F.max("count")).first()[0] < 3000 / K.GRAM_SALTS * 2.5


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.9])
def test_similar_equals_brute_force(spark, threshold):
    sets = {tuple(sorted(set(x.split()))) for x in random_names(3, 150, 1, 9)}
    df = spark.createDataFrame([("T", " ".join(s), list(s)) for s in sets], "entity_type string, key string, t array<string>")
    got = {(r.a, r.b) for r in K.similar(df, df, ["entity_type"], threshold).collect()}
    jac = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    assert got == {(" ".join(x), " ".join(y)) for x, y in itertools.product(sets, sets) if jac(x, y) >= threshold}


def test_resolver_equals_definition(spark):
    known = ["Acme Widgets", "Blue Steel Ltd", "One Two Three Four", "Zed"]
    asked = ["ACME widgets", "Blue Steel", "Acme Widgets Inc.", "two one three four", "Zed Holdings", "nothing here", "one two three five", ""]
    q = spark.createDataFrame([(a, "T") for a in asked], "name string, entity_type string")
    got = {r.name: (r.tier, r.id) for r in K.resolve(q, nodes_of(spark, known)).collect()}
    assert got == {"ACME widgets": (1, "n000"), "Blue Steel": (2, "n001"), "Acme Widgets Inc.": (2, "n000"),
                   "two one three four": (4, "n002"), "Zed Holdings": (3, "n003")}
    other = spark.createDataFrame([("Zed", "U")], "name string, entity_type string")
    assert K.resolve(other, nodes_of(spark, known)).count() == 0


def test_fuzzy_dedup_short_long_and_transitive(spark):
    base = [f"w{k}" for k in range(20)]
    long = [" ".join(base), " ".join(base[:-1] + ["q1"]), " ".join(base[:-2] + ["q1", "q2"])]     # a~b, b~c, not a~c
    names = ["red ring", "Ring, RED", "red rings", "!!!", "???", *long]
    n = nodes_of(spark, names)
    e = edges_of(spark, [("n001", "n002", 0.5), ("n000", "n001", 0.9), ("n005", "n002", 0.3), ("n006", "n002", 0.8)])
    dup = {r.id: r.survivor for r in K.duplicate_map(n, e).collect()}
    assert dup["n000"] == dup["n001"] == "n001" and dup["n002"] == "n002" and dup["n003"] == "n003" and dup["n004"] == "n004"
    jac = lambda x, y: len(set(x.split()) & set(y.split())) / len(set(x.split()) | set(y.split()))
    assert jac(long[0], long[1]) >= 0.9 > jac(long[0], long[2])
    assert dup["n005"] == dup["n006"] == dup["n007"]
    nodes, edges = K.rewrite(n, e, K.duplicate_map(n, e))
    assert nodes.count() == 5
    assert sorted((r.from_id, r.to_id, r.confidence) for r in edges.collect()) == [("n001", "n002", 0.5), (dup["n005"], "n002", 0.8)]


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.9])
def test_fuzzy_dedup_equals_brute_force(spark, threshold):
    names = sorted(set(random_names(5, 90, 2, 6)))
    dup = {r.id: r.survivor for r in K.duplicate_map(nodes_of(spark, names), edges_of(spark, [("n000", "n001", 0.5)]), threshold).collect()}
    sets, root = [set(x.split()) for x in names], list(range(len(names)))
    for _ in names:
        for i, j in itertools.combinations(range(len(names)), 2):
            if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12:
                root[i] = root[j] = min(root[i], root[j])
    for i, j in itertools.combinations(range(len(names)), 2):
        assert (dup[f"n{i:03d}"] == dup[f"n{j:03d}"]) == (root[i] == root[j])


def test_components(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("f", "e"), ("z", "c")], "a string, b string")
    got = {r.node: r.component for r in components(pairs).collect()}
    assert got == {**{k: "a" for k in "abcz"}, **{k: "d" for k in "def"}}


def test_components_of_a_large_star(spark):
    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = components(star)
    assert got.count() == 100_001 and got.where("component != 0").isEmpty()


def test_pairs_come_from_all_nodes(spark):
    n = nodes_of(spark, [f"x{k}" for k in range(40)]).withColumn("domain", F.when(F.col("id") < "n020", "p").otherwise("q"))
    ids = [f"n{k:03d}" for k in range(40)]
    linked = [(a, b, 1) for a in ids[:20] for b in ids[20:] if (a, b) not in {("n003", "n030"), ("n019", "n039")}]
    got = K.affinity_pairs(n, edges_of(spark, linked), 5).collect()
    assert {(r.a, r.b) for r in got} == {("n003", "n030"), ("n019", "n039")}
    assert K.affinity_pairs(n.withColumn("domain", F.lit("p")), edges_of(spark, linked), 5).count() == 0


def test_every_pair_is_drawn_at_last(spark):
    n = nodes_of(spark, [f"x{k}" for k in range(10)]).withColumn("domain", F.when(F.col("id") < "n005", "p").otherwise("q"))
    none = edges_of(spark, [("n000", "n001", 1)])
    drawn = [sorted((r.a, r.b) for r in K.affinity_pairs(n, none, 100, seed).collect()) for seed in ("", "1")]
    assert drawn == [sorted((f"n{a:03d}", f"n{b:03d}") for a in range(5) for b in range(5, 10))] * 2
    few = [{(r.a, r.b) for r in K.affinity_pairs(n, none, 7, seed).collect()} for seed in ("", "1", "")]
    assert few[0] == few[2] != few[1] and {len(x) for x in few} == {7}


def test_as_many_pairs_as_asked_at_every_shape(spark):
    """Two nodes of one domain and many of another: all pairs but the linked ones, whatever the number asked."""
    n = nodes_of(spark, [f"x{k}" for k in range(302)]).withColumn("domain", F.when(F.col("id") < "n002", "p").otherwise("q"))
    linked = {("n000", f"n{b:03d}") for b in range(2, 290)}
    edges = edges_of(spark, [(a, b, 1) if int(b[1:]) % 2 else (b, a, 1) for a, b in linked])
    possible = {(f"n{a:03d}", f"n{b:03d}") for a in (0, 1) for b in range(2, 302)} - linked
    for ask in (200, len(possible), 1000):
        got = [(r.a, r.b) for r in K.affinity_pairs(n, edges, ask).collect()]
        assert len(got) == len(set(got)) == min(ask, len(possible)) and set(got) <= possible


def test_schema_pairs_against_brute_force(spark):
    n = nodes_of(spark, [f"x{k}" for k in range(30)]).withColumn("domain", F.when(F.col("id") < "n020", "p").otherwise("q"))
    linked = {("n000", f"n{b:03d}") for b in range(20, 30)}
    edges = edges_of(spark, [(a, b, 1) for a, b in linked])
    schemas = spark.createDataFrame([("pq", "p", "q", None, None), ("pp", "p", "p", None, None), ("none", "p", "z", None, None)],
                                    "schema string, from_domain string, to_domain string, from_types array<string>, to_types array<string>")
    ids = [f"n{k:03d}" for k in range(30)]
    want = {"pq": {(a, b) for a in ids[:20] for b in ids[20:]} - linked, "pp": {(a, b) for a in ids[:20] for b in ids[:20] if a != b}}
    for ask in (7, 1000):
        got = {}
        for r in K.schema_pairs(n, edges, schemas, ask).collect():
            got.setdefault(r.schema, []).append((r.a, r.b))
        assert {s: len(v) for s, v in got.items()} == {s: min(ask, len(v)) for s, v in want.items()}
        assert all(set(v) <= want[s] and len(set(v)) == len(v) for s, v in got.items())


def test_walks_from_many_starts_equal_single_ones(spark, monkeypatch):
    import random

    from marketloom.operators import walks

    monkeypatch.setattr(walks, "HUB_SHARE", 20)  # some nodes are hubs
    rng = random.Random(3)
    rows = [(f"{rng.randrange(90)}", f"{rng.randrange(90) if rng.random() < 0.7 else 0}", f"e{k:03d}") for k in range(260)] + [("0", f"{k}", f"h{k:03d}") for k in range(60)]
    e = spark.createDataFrame(rows, "from_id string, to_id string, id string")
    names = [str(k) for k in range(80)] + ["none"]
    starts = spark.createDataFrame([(x,) for x in names], "id string")
    want, near, used = set(), set(), set()
    for s in names:
        frontier, seen = {s}, set()
        for hop in (1, 2, 3):
            found = {}
            for a, b, k in rows:
                if a in frontier and b not in seen:
                    found[b] = min(found.get(b, (a, k)), (a, k))
            want |= {(s, hop, a, k, b) for b, (a, k) in found.items()}
            frontier, seen = set(found), seen | set(found)
        level = {s: 0}
        for hop in (1, 2):
            for a, b, k in rows:
                for x, y in ((a, b), (b, a)):
                    if level.get(x) == hop - 1:
                        used.add((s, k))
                        level.setdefault(y, hop)
        near |= {(s, x, h) for x, h in level.items()}
    assert {tuple(r) for r in G.expand(e, starts, 3).collect()} == want
    seen, edges = G.surroundings(e, starts, 2)
    assert {tuple(r) for r in seen.select("start", "id", "hop").collect()} == near
    assert {tuple(r) for r in edges.select("start", "edge").collect()} == used
    masks, who = walks.within(e, starts, 2)
    both = masks[0].union(masks[1]).union(masks[2])
    assert {tuple(r) for r in walks.count_bits(both, who).collect()} == {(s, len([1 for x in near if x[0] == s])) for s in names}


def test_batches_are_full(spark):
    d = G.batches(spark.range(1003).selectExpr("CAST(id AS STRING) AS id").repartition(7), "id", 64)
    sizes = sorted(r["count"] for r in d.groupBy("batch").count().collect())
    assert sizes == [1003 % 64] + [64] * 15 and d.agg(F.max("batch")).first()[0] == 15
    order = [r.id for r in d.orderBy("batch", "id").collect()]
    assert order == sorted(order)
    assert G.batches(spark.range(0).selectExpr("CAST(id AS STRING) AS id"), "id", 64).count() == 0


def test_keyword_search_reads_the_description(spark):
    n = nodes_of(spark, ["Acme", "Blue"]).withColumn("description", F.when(F.col("canonical_name") == "Blue", "all about Widgets"))
    assert [r.canonical_name for r in G.keyword_search(n, ["widgets"]).collect()] == ["Blue"]


def test_resolver_without_types(spark):
    n = nodes_of(spark, ["Acme Widgets", "Blue Steel Ltd"]).union(nodes_of(spark, ["x", "y", "Zed Group"], "U").where("canonical_name = 'Zed Group'"))
    q = spark.createDataFrame([("Blue Steel",), ("zed",), ("none",)], "name string")
    assert {r.name: (r.tier, r.id) for r in K.resolve(q, n).collect()} == {"Blue Steel": (2, "n001"), "zed": (3, "n002")}


def test_labels_fill_a_key_without_value(spark):
    d = spark.sql("SELECT 'e' AS id, 'LLM_AFFINITY' AS relation_type, map('inferred_relation', CAST(NULL AS STRING), 'k', 'v') AS attributes")
    got = K.label_edges(d, spark.sql("SELECT 'e' AS id, 'moves' AS label")).first().attributes
    assert got == {"inferred_relation": "moves", "k": "v"}


def test_build_keeps_what_it_is_given(spark):
    n = nodes_of(spark, ["Acme Widgets Ltd", "Blue Steel"], "Organization").withColumns({"description": F.lit("about"), "ticker": F.col("id")})
    e = edges_of(spark, [("n000", "n001", 0.9)]).withColumns({"relation_type": F.lit("PARTNERED_WITH"), "attributes": F.create_map(F.lit("since"), F.lit("1999")), "created_at": F.lit("2020-01-01").cast("timestamp")})
    x = spark.sql("""SELECT 'u' AS source_url, array(named_struct('entity_type', 'Organization', 'canonical_name', 'Newco', 'aliases', array('NC'), 'attributes', map('a', '1'), 'confidence', 0.9D)) AS entities,
      array(named_struct('relation_type', 'ACQUIRED', 'from_entity', 'Newco', 'to_entity', 'acme widgets inc', 'weight', 0.7D, 'attributes', map('price', '5'))) AS relations""")
    nothing = lambda d: d.where("false").withColumns({"weight": F.lit(1.0), "relation": F.lit("R"), "confidence": F.lit(1.0)})
    schemas = spark.createDataFrame([], "schema string, from_domain string, to_domain string, from_types array<string>, to_types array<string>")
    nodes, edges = K.build(x, n, e, K.ontology_types(spark), K.ontology_relations(spark), K.allowed_attributes(spark, {}), nothing, schemas, nothing,
                           spark.createDataFrame([], "schema string, relation string"), lambda d: d.select("id", F.lit("l").alias("label")))
    got = {r.relation_type: r for r in edges.collect()}
    assert got["PARTNERED_WITH"].attributes == {"since": "1999"} and got["PARTNERED_WITH"].created_at.year == 2020
    assert got["ACQUIRED"].attributes == {"price": "5"} and got["ACQUIRED"].to_id == "n000"
    assert {(r.description, r.ticker) for r in nodes.collect()} == {("about", "n000"), ("about", "n001"), (None, None)}


def test_names(spark):
    d = spark.createDataFrame([("  ACME, Ltd. ", ), ("Foo & Co", ), ("Inc", ), (None, )], "t string")
    got = [(r.n, r.k) for r in d.select(X.normalize_name(F.col("t")).alias("n"), X.canonical_key(F.col("t")).alias("k")).collect()]
    assert got == [("acme ltd", "acme"), ("foo co", "foo"), ("inc", ""), ("", "")]
