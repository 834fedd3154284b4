"""Knowledge-graph building: admission, entity resolution, fuzzy dedup, candidate pairs.

The published flow resolves item by item, so earlier items shape later matches. Here a whole
batch is resolved against (existing ∪ batch) at once; results do not depend on arrival order.
"""
from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from decimal import Decimal
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.numeric import nz
from ..functions.scalars import all_names, canonical_key, normalize_name, recover_array, strip, tokens
from ..session import cut_lineage
from ..sources.landing import top_rank
from .components import components
from .graph import best_edges
from .numbering import numbered

c = F.col

# Vocabularies per domain. Attribute lists are data: see `allowed_attributes`.
ENTITY_TYPES = {
    "corporate": ["Organization", "Person", "Product", "Market", "DealEvent", "Regulation"],
    "geopolitics": ["Country", "PoliticalLeader", "Alliance", "Conflict", "Treaty", "SanctionEvent"],
    "climate": ["ClimateEvent", "ClimatePolicy", "NaturalResource", "ClimateIndicator", "ClimateOrganization"],
    "technology": ["TechCompany", "Technology", "ResearchPaper", "Patent", "TechEvent", "TechRegulation"],
    "india_finance": ["IndianCompany", "Conglomerate", "Sector", "StockIndex", "MutualFund", "ETF"],
    "india_policy": ["GovernmentPolicy", "RBIDecision", "SEBIRegulation", "BudgetEvent", "GovernmentScheme",
        "Regulator"],
    "india_economy": ["MacroIndicator", "EconomicTrend", "ForeignInvestment", "TradeData", "InfrastructureProject"],
    "india_corporate": ["Promoter", "CorporateEvent", "StartupFunding", "Analyst", "BusinessGroup"],
}
RELATION_TYPES = {
    "corporate": ["HEADQUARTERED_IN", "CEO_OF", "BOARD_MEMBER_OF", "COMPETES_WITH", "ACQUIRED", "PARTNERED_WITH",
        "SUPPLIES_TO", "INVESTED_IN", "REGULATED_BY", "OPERATES_IN", "LAUNCHED", "MERGED_WITH", "LLM_AFFINITY"],
    "geopolitics": ["ALLY_OF", "RIVAL_OF", "SANCTIONS", "INVADED", "SIGNED_TREATY_WITH", "MEMBER_OF", "LED_BY",
        "TRADES_WITH", "HOSTS_BASE_IN", "CONFLICT_WITH", "BORDERS", "LLM_AFFINITY"],
    "climate": ["CAUSED_BY", "IMPACTS", "REGULATES", "SIGNED_AGREEMENT", "EMITS", "DEPENDS_ON", "THREATENED_BY",
        "MONITORS", "FUNDS", "LOCATED_IN", "LLM_AFFINITY"],
    "technology": ["DEVELOPED_BY", "ACQUIRED_BY", "COMPETES_WITH", "PARTNERED_WITH", "INVESTED_IN", "USES",
        "REGULATES", "PUBLISHED_BY", "CITED_BY", "PATENTED_BY", "SUCCESSOR_OF", "POWERS", "LLM_AFFINITY"],
    "india_finance": ["LISTED_ON", "PART_OF_CONGLOMERATE", "IN_SECTOR", "TRACKS_INDEX", "COMPETES_WITH", "ACQUIRED",
        "INVESTED_IN", "SUBSIDIARY_OF", "PROMOTED_BY", "CONSTITUENT_OF", "LLM_AFFINITY"],
    "india_policy": ["REGULATED_BY_SEBI", "REGULATED_BY_RBI", "IMPACTED_BY_POLICY", "ANNOUNCED_IN_BUDGET",
        "BENEFITS_FROM_SCHEME", "ISSUED_BY", "TARGETS_SECTOR", "SUPERSEDES", "AMENDED_BY", "LLM_AFFINITY"],
    "india_economy": ["DRIVES", "IMPACTS", "CORRELATES_WITH", "MEASURES", "FLOWS_INTO", "FLOWS_FROM", "AFFECTS_SECTOR",
        "FUNDED_BY", "EXECUTED_BY", "LLM_AFFINITY"],
    "india_corporate": ["PROMOTED_BY", "FUNDED_BY", "ACQUIRED_BY", "PARTNERED_WITH", "REPORTED_EARNINGS",
        "COVERED_BY_ANALYST", "RATED_BY", "COMPETES_WITH", "BELONGS_TO_GROUP", "SPUN_OFF_FROM", "LLM_AFFINITY"],
}
AFFINITY_FLOOR, AFFINITY_CONFIDENCE, TYPED_FLOOR = 0.15, 0.7, 0.60
RESOLVE_JACCARD, DEDUP_JACCARD = 0.75, 0.90
DEFAULT_CONFIDENCE = DEFAULT_WEIGHT = 0.8


# ── vocabulary ──────────────────────────────────────────────────────────────────────
def ontology_types(spark: SparkSession, table: dict[str, list[str]] = ENTITY_TYPES) -> DataFrame:
    rows = [(d, t) for d, ts in table.items() for t in ts]
    return spark.createDataFrame(rows, "domain string, entity_type string")


def ontology_relations(spark: SparkSession, table: dict[str, list[str]] = RELATION_TYPES) -> DataFrame:
    rows = [(d, t) for d, ts in table.items() for t in ts]
    return spark.createDataFrame(rows, "domain string, relation_type string")


def allowed_attributes(spark: SparkSession, allowed: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in allowed.items()], "entity_type string, allowed array<string>")


def with_valid_type(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Known entity types only, with their domain; one domain per type."""
    return rows.join(types.groupBy("entity_type").agg(F.min("domain").alias("domain")), "entity_type")


def sanitize(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Drop attribute keys outside the type's whitelist; types without one pass through."""
    d = rows.join(allowed, "entity_type", "left")
    kept = F.when(c("allowed").isNull(), c("attributes")).otherwise(
        F.map_filter("attributes", lambda k, v: F.array_contains(c("allowed"), k)))
    return d.withColumn("attributes", kept).drop("allowed")


# ── admission ───────────────────────────────────────────────────────────────────────
def admit_entities(extractions: DataFrame, types: DataFrame, allowed: DataFrame) -> DataFrame:
    """Extraction rows → validated entities (E01): trimmed name, known type, listed attributes."""
    d = extractions.select("source_url", F.explode("entities").alias("e")).select("source_url", "e.*")
    d = d.withColumn("canonical_name", strip(nz(c("canonical_name"), ""))).where(c("canonical_name") != "")
    d = with_valid_type(d, types)
    d = d.withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))
    d = sanitize(d, allowed)
    conf = F.when(nz(c("confidence")) == 0, DEFAULT_CONFIDENCE).otherwise(c("confidence"))
    return d.withColumn("confidence", conf).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


#: Node columns that a merge takes from the first row that has them.
PLAIN = ["description", "ticker", "created_at", "updated_at"]


@dataclass(frozen=True)
class Merged:
    """Entities of equal key as tables (E02, E04). `entities` has the key, the name and rank (`first`)
    of the first row, the highest confidence and the first known plain columns; `names`, `sources` and
    `attributes` hold one row per (key, name), (key, source) and (key, field) with the first value."""
    key: list[str]
    entities: DataFrame
    names: DataFrame
    sources: DataFrame
    attributes: DataFrame
    plain: list[str]

    def nodes(self) -> DataFrame:
        """Node rows with lists: names besides the canonical one are aliases."""
        def listed(d, values, name):
            return d.groupBy(*self.key).agg(values.alias(name))

        d = self.entities.join(listed(self.names, F.array_sort(F.collect_list("name")), "names"), self.key, "left")
        d = d.join(listed(self.sources, F.array_sort(F.collect_list("source")), "sources"), self.key, "left")
        fields = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value"))))
        d = d.join(listed(self.attributes, fields, "attributes"), self.key, "left")
        none = F.array().cast("array<string>")
        return d.select(*self.key, "canonical_name", F.coalesce(F.array_remove("names", c("canonical_name")), none).alias("aliases"),
                        F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
                        F.coalesce("sources", none).alias("sources"), "confidence", *self.plain)


def merge_tables(rows: DataFrame, key: list[str], rank: str) -> Merged:
    """Merge rows of one entity into tables. First values are taken by rank; a map task keeps one row
    per key and field, and names and sources are distinct rows, so neither a hot entity nor its
    provenance becomes one large row or group."""
    plain = [x for x in PLAIN if x in rows.columns]
    first = top_rank(rows.select(*key, "canonical_name", c(rank).alias("first")), key, [c("first")], 1)
    d = first.join(rows.groupBy(*key).agg(F.max("confidence").alias("confidence")), key)
    for x in plain:
        known = rows.where(c(x).isNotNull()).select(*key, x, c(rank).alias("_rank"))
        d = d.join(top_rank(known, key, [c("_rank")], 1).drop("_rank"), key, "left")
    fields = rows.select(*key, c(rank).alias("_rank"), F.explode("attributes").alias("field", "value"))
    return Merged(key, d, rows.select(*key, F.explode(all_names(c("canonical_name"), c("aliases"))).alias("name")).distinct(),
                  rows.select(*key, F.explode("sources").alias("source")).distinct(),
                  top_rank(fields, [*key, "field"], [c("_rank")], 1).drop("_rank"), plain)


def merge_rows(rows: DataFrame, key: list[str], rank: str) -> DataFrame:
    """`merge_tables` as node rows."""
    return merge_tables(rows, key, rank).nodes()


def admit_relations(extractions: DataFrame, relations: DataFrame, local: DataFrame, resolver: DataFrame) -> DataFrame:
    """Extraction rows → edges (E03). `local` (source_url, name, id) wins over `resolver`
    (name, id); unresolved ends and self-loops are dropped, duplicates keep the best."""
    d = extractions.select("source_url", F.posexplode("relations").alias("pos", "r")).select("source_url", "pos", "r.*")
    d = d.join(relations.select("relation_type").distinct(), "relation_type", "left_semi")
    for end in ("from", "to"):
        d = d.join(local.select("source_url", c("name").alias(f"{end}_entity"), c("id").alias("_l")), ["source_url", f"{end}_entity"], "left")
        d = d.join(resolver.select(c("name").alias(f"{end}_entity"), c("id").alias("_g")), f"{end}_entity", "left")
        d = d.withColumn(f"{end}_id", F.coalesce("_l", "_g")).drop("_l", "_g")
    d = d.where(c("from_id").isNotNull() & c("to_id").isNotNull() & (c("from_id") != c("to_id")))
    weight = F.when(nz(c("weight")) == 0, DEFAULT_WEIGHT).otherwise(c("weight"))
    held = c("attributes") if "attributes" in d.columns else F.lit(None)
    held = F.coalesce(held.cast("map<string,string>"), F.create_map().cast("map<string,string>"))
    d = d.select(held.alias("attributes"), F.sha2(F.concat_ws("|", "source_url", "pos", "relation_type", "from_id", "to_id"), 256).alias("id"), "relation_type",
                 "from_id", "to_id", weight.alias("weight"), F.array("source_url").alias("sources"), F.lit(DEFAULT_CONFIDENCE).alias("confidence"))
    return best_edges(d)


def name_index(nodes: DataFrame) -> DataFrame:
    """Normalised name → ids."""
    d = nodes.select("id", "entity_type", F.explode(all_names(c("canonical_name"), c("aliases"))).alias("n"))
    return d.select(normalize_name(c("n")).alias("norm_name"), "id", "entity_type").distinct()


# ── resolution ──────────────────────────────────────────────────────────────────────
#: Texts that may share one gram before the gram counts as common.
GRAM_GROUP = 2000
#: A common gram holds more than this part of all rows as well, so there are fewer common grams than this.
GRAM_SHARE = 1000
#: Parts into which the texts of a common gram are dealt.
GRAM_SALTS = 64
SHORT, LONG = 3, 8
#: Grams whose table joins may broadcast.
LIGHT = 100_000


def _grams(t: Column, lengths) -> Column:
    """Distinct substrings of the given lengths."""
    def cut(n):
        at = F.sequence(F.lit(1), F.length(t) - (n - 1))
        return F.when(F.length(t) >= n, F.transform(at, lambda k: F.substr(t, k, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.array().cast("array<string>"), *[cut(n) for n in lengths]))


def _lengths(needles: DataFrame, most: int) -> list[int]:
    """Lengths of the grams under which needles are looked up: their own, `most` at most."""
    return sorted(r[0] for r in needles.select(F.least(F.length("needle"), F.lit(most))).distinct().collect())  # up to `most` numbers


def _dealt(h: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, bool]:
    """Texts per gram (`h`) with a part number, (by, g, df, common) of every gram, and whether any
    is common. Texts of a common gram are dealt out by hash, the others all have part 0. Common
    grams number under GRAM_SHARE by their definition, so their table may be broadcast."""
    freq = cut_lineage(h.groupBy(*by, "g").agg(F.count(F.lit(1)).alias("df")))
    grams, rows, most = freq.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.max("df"), F.lit(0))).first()
    bound = max(GRAM_GROUP, rows / GRAM_SHARE)
    freq = _light(freq.withColumn("common", c("df") > bound), grams)
    if most <= bound:
        return h.withColumns({"common": F.lit(False), "part": F.lit(0)}), freq, False
    common = freq.where("common").select(*by, "g", "common")
    part = F.when(c("common"), F.pmod(F.xxhash64("hay"), F.lit(GRAM_SALTS))).otherwise(0).cast("int")
    return h.join(F.broadcast(common), [*by, "g"], "left").withColumn("part", part), freq, True


def _light(d: DataFrame, rows: int) -> DataFrame:
    """Table of grams that joins may broadcast if it has few rows."""
    return F.broadcast(d) if rows <= LIGHT else d


def _rarest(needles: DataFrame, most: int, freq: DataFrame, by: list[str]) -> DataFrame:
    """Every needle with its rarest gram of `most` letters, or itself when shorter; a needle with a gram
    that no text holds is left out. Count and place of a gram share one long, which a hash aggregate can keep."""
    size = F.least(F.length("needle"), F.lit(most))
    at = needles.withColumn("k", F.explode(F.sequence(F.lit(1), F.length("needle") - size + 1)))
    n = at.withColumn("g", F.substr("needle", c("k"), size)).join(freq, [*by, "g"], "left")
    rank = F.shiftleft(nz(c("df"), 0), 32) + F.when(c("common"), 1 << 31).otherwise(0) + c("k")
    n = n.groupBy(*needles.columns).agg(F.min(rank).alias("_r")).where(c("_r") >= 1 << 32)
    place = c("_r").bitwiseAND((1 << 31) - 1).cast("int")
    return n.select(*needles.columns, F.substr("needle", place, size).alias("g"), (c("_r").bitwiseAND(1 << 31) != 0).alias("common"))


def inside(needles: DataFrame, hay: DataFrame, by: list[str]) -> DataFrame:
    """Rows of `needles` (by, needle, …) beside the rows of `hay` (by, hay, …) whose text holds the
    needle. Texts must be distinct within `by`; null and empty needles lie nowhere.

    A needle can only lie inside a text that has all its grams, so it is looked up under its rarest
    one of three letters (or as a whole when shorter) and verified. When even that one is common,
    the needle is looked up under its rarest one of eight letters, or as a whole when shorter. Texts
    of grams that are still common are dealt into parts, and their needles visit every part, so no
    group grows with the share of texts that hold a gram. Texts are cut only into grams of lengths
    that needles ask for, and moved only under grams that needles chose. Every pair appears once."""
    n = cut_lineage(needles.where(c("needle") != ""))
    keep = hay.columns
    h, freq, any_common = _dealt(hay.withColumn("g", F.explode(_grams(c("hay"), _lengths(n, SHORT)))), by)
    n = cut_lineage(_rarest(n, SHORT, freq, by))
    climbs = c("common") & (F.length("needle") > SHORT)
    stay = n.where(~climbs)
    found = _met(stay, _asked(h, stay, by), by, keep)
    lengths = _lengths(n.where(climbs), LONG) if any_common else []
    if not lengths:
        return found
    asked = n.where(climbs).select(*by, "g").distinct()  # common grams: under GRAM_SHARE rows
    tall = cut_lineage(h.where("common").join(F.broadcast(asked), [*by, "g"], "left_semi").select(*keep).distinct())
    n = n.where(climbs).select(*needles.columns)
    tall, freq, _ = _dealt(tall.withColumn("g", F.explode(_grams(c("hay"), lengths))), by)
    n = cut_lineage(_rarest(n, LONG, freq, by))
    return found.unionByName(_met(n, _asked(tall, n, by), by, keep))


def _asked(h: DataFrame, n: DataFrame, by: list[str]) -> DataFrame:
    """Texts under the grams that needles chose; left as they are when these are too many to broadcast."""
    chosen = n.select(*by, "g").distinct()
    rows = chosen.count()
    return h.join(F.broadcast(chosen), [*by, "g"], "left_semi") if rows <= LIGHT else h


def _met(n: DataFrame, h: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Needles beside the texts of their gram that hold them."""
    parts = F.when(c("common"), F.sequence(F.lit(0), F.lit(GRAM_SALTS - 1))).otherwise(F.array(F.lit(0)))
    n = n.withColumn("part", F.explode(parts)).drop("common")
    return n.join(h.select(*keep, "g", "part"), [*by, "g", "part"]).where(F.contains("hay", c("needle"))).drop("g", "part")


def contained(needles: DataFrame, hay: DataFrame, by: list[str]) -> DataFrame:
    """Distinct (by, text) needles inside distinct (by, text) hays as (by, needle, hay) rows."""
    n, h = (d.select(*by, c("text").alias(x)).distinct() for d, x in ((needles, "needle"), (hay, "hay")))
    return inside(n, h, by).select(*by, "needle", "hay")


def similar(left: DataFrame, right: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Pairs of distinct token sets (by, key, t) with Jaccard ≥ threshold, by prefix filter:
    similar sets share a token among their rarest |t| − ⌈threshold·|t|⌉ + 1 ones."""
    left, right = (d.select(*by, "key", F.array_sort("t").alias("t")).distinct() for d in (left, right))  # one order per set
    vocab = left.union(right).distinct()
    freq = vocab.select(*by, F.explode("t").alias("tok")).groupBy(*by, "tok").agg(F.count(F.lit(1)).alias("df"))

    def prefix(side):
        d = side.withColumn("tok", F.explode("t")).join(freq, [*by, "tok"])
        w = Window.partitionBy(*by, "key").orderBy("df", "tok")
        size = F.size("t")
        return (d.withColumn("r", F.row_number().over(w))
                .where(c("r") <= size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)) + 1).select(*by, "key", "t", "tok"))

    a = prefix(left).select(*by, "tok", c("key").alias("a"), c("t").alias("ta"))
    b = prefix(right).select(*by, "tok", c("key").alias("b"), c("t").alias("tb"))
    both = a.join(b, [*by, "tok"]).where((F.least(F.size("ta"), F.size("tb")) >= threshold * F.greatest(F.size("ta"), F.size("tb"))))
    shared = F.size(F.array_intersect("ta", "tb"))
    score = shared / (F.size("ta") + F.size("tb") - shared)
    return both.withColumn("score", score).where(c("score") >= threshold).select(*by, "a", "b", "score").distinct()


def resolve(queries: DataFrame, nodes: DataFrame, tiers: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Best existing entity per (query, entity_type) (E06; tiers=(1, 3) gives E07), or per query
    among entities of all types when the queries have no entity_type.

    Tiers: exact normalised name, canonical key, containment either way, token Jaccard ≥ .75.
    Names are reduced to distinct texts with their smallest id first; every tier is an
    equi-join on text, gram or token, and only queries still open reach the next tier."""
    by = ["entity_type"] if "entity_type" in queries.columns else []
    d = queries.select("name", *by).distinct().withColumn("norm", normalize_name(c("name")))
    text = name_index(nodes).where(c("norm_name") != "").groupBy(*by, c("norm_name").alias("text")).agg(F.min("id").alias("id"))
    if 3 in tiers or 4 in tiers:
        text = cut_lineage(text)
    none = F.lit(None).cast("string")
    if 1 in tiers:
        d = d.join(text.select(*by, c("text").alias("norm"), c("id").alias("id1")), [*by, "norm"], "left")
    else:
        d = d.withColumn("id1", none)
    if 2 in tiers:
        keys = nodes.select(*by, canonical_key(c("canonical_name")).alias("key"), "id").where(c("key") != "")
        keys = keys.groupBy(*by, "key").agg(F.min("id").alias("id2"))
        d = d.withColumn("key", canonical_key(c("name"))).join(keys, [*by, "key"], "left")
    else:
        d = d.withColumn("id2", none)
    d = d.select("name", *by, "norm", "id1", "id2")
    if 3 in tiers or 4 in tiers:
        d = cut_lineage(d)
    rest = d.where(c("id1").isNull() & c("id2").isNull() & (c("norm") != "")).select(*by, "norm").distinct()
    if 3 in tiers:
        held = inside(rest.withColumnRenamed("norm", "needle"), text.withColumnRenamed("text", "hay"), by)
        holds = inside(text.withColumnRenamed("text", "needle"), rest.withColumnRenamed("norm", "hay"), by)
        hit = (held.select(*by, c("needle").alias("norm"), "id").union(holds.select(*by, c("hay").alias("norm"), "id"))
               .groupBy(*by, "norm").agg(F.min("id").alias("id3")))
        d = d.join(hit, [*by, "norm"], "left")
    else:
        d = d.withColumn("id3", none)
    if 4 in tiers:
        def sets(df, col):
            return df.select(*by, c(col).alias("key"), tokens(c(col)).alias("t")).where(F.size("t") > 0)

        hit = (similar(sets(rest, "norm"), sets(text, "text"), by, RESOLVE_JACCARD)
               .join(text.withColumnRenamed("text", "b"), [*by, "b"]).groupBy(*by, c("a").alias("norm"))
               .agg(F.min(F.struct(-c("score"), c("id")))["id"].alias("id4")))
        d = d.join(hit, [*by, "norm"], "left")
    else:
        d = d.withColumn("id4", none)
    ids = [f"id{k}" for k in (1, 2, 3, 4)]
    tier = F.coalesce(*[F.when(c(x).isNotNull(), k + 1) for k, x in enumerate(ids)])
    return d.select("name", *by, F.coalesce(*ids).alias("id"), tier.alias("tier")).where(c("id").isNotNull())


# ── fuzzy dedup ─────────────────────────────────────────────────────────────────────
def duplicate_map(nodes: DataFrame, edges: DataFrame, threshold: float = DEDUP_JACCARD) -> DataFrame:
    """(id, survivor) for every node (E08), clusters within a type.

    Names with too few tokens for any different set to reach the threshold (under nine at .90)
    match by equal token sets: one aggregate, however many copies a name has. The others go
    through the prefix-filter join and connected components."""
    degree = (edges.select(c("from_id").alias("id")).union(edges.select(c("to_id").alias("id")))
              .groupBy("id").agg(F.count(F.lit(1)).alias("degree")))
    n = nodes.select("id", "entity_type", "confidence", tokens(c("canonical_name")).alias("t")).join(degree, "id", "left")
    n = n.withColumn("score", c("confidence") + 0.001 * nz(c("degree"), 0))
    n = n.withColumn("key", F.when(F.size("t") > 0, F.array_join(F.array_sort("t"), " ")).otherwise(F.concat(F.lit("\x00"), c("id"))))
    # two different sets with i shared tokens reach i / (i + 1) at most, so both hold t / (1 - t) tokens
    shared = math.ceil(threshold / (1 - threshold) - 1e-9) if threshold < 1 else None
    long = n.where(F.size("t") >= shared if shared else F.lit(False)).select("entity_type", "key", "t").distinct()
    merged = n.withColumn("cluster", c("key"))
    if not long.isEmpty():
        pair = similar(long, long, ["entity_type"], threshold).where(c("a") < c("b"))
        sep = F.lit("\x01")
        pair = pair.select(F.concat("entity_type", sep, "a").alias("a"), F.concat("entity_type", sep, "b").alias("b"))
        root = components(pair).select(c("node").alias("_v"), F.substring_index("component", "\x01", -1).alias("_root"))
        merged = (n.join(root, F.concat("entity_type", sep, "key") == c("_v"), "left")
                  .withColumn("cluster", F.coalesce("_root", "key")).drop("_v", "_root"))
    keep = top_rank(merged.select("entity_type", "cluster", "score", c("id").alias("survivor")), ["entity_type", "cluster"], [-c("score"), c("survivor")], 1)
    return merged.join(keep.drop("score"), ["entity_type", "cluster"]).select("id", "entity_type", "survivor")


def rewrite(nodes: DataFrame, edges: DataFrame, dup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge losers into survivors and redirect, collapse and clean their edges."""
    m = cut_lineage(dup.select("id", "survivor"))
    rows = nodes.join(m, "id").withColumn("rank", F.struct((c("id") != c("survivor")).cast("int").alias("loser"), "id"))
    kinds = nodes.select("id", "entity_type", "domain").withColumnRenamed("id", "survivor")
    plain = [x for x in PLAIN if x in nodes.columns]
    merged = merge_rows(rows.select("survivor", "canonical_name", "aliases", "attributes", "sources", "confidence", "rank", *plain), ["survivor"], "rank")
    new_nodes = merged.join(kinds, "survivor").withColumnRenamed("survivor", "id")
    e = edges
    for end in ("from_id", "to_id"):
        e = e.join(m.select(c("id").alias(end), c("survivor").alias(f"_{end}")), end).drop(end).withColumnRenamed(f"_{end}", end)
    return new_nodes, best_edges(e.where(c("from_id") != c("to_id")))


# ── candidate pairs ─────────────────────────────────────────────────────────────────
def unlinked(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b) without an edge in either direction."""
    both = edges.select(c("from_id").alias("a"), c("to_id").alias("b")).union(edges.select(c("to_id"), c("from_id")))
    return pairs.join(both, ["a", "b"], "left_anti")


#: Pairs of a walk that one generated row stands for, and pairs tried at first for each one asked.
CHUNK, TRIES = 10_000, 4


def _step(total: int) -> int:
    """A stride through 0 … total − 1 that meets every number once, about 0.618 of the whole."""
    return next(k for k in range(total * 618 // 1000 + 1, 2 * total + 2) if gcd(k, total) == 1)


def _walk(spark, spaces: dict[str, int], blocks: DataFrame, nodes: DataFrame, edges: DataFrame, n: int, seed: str) -> DataFrame:
    """(space, t, a, b): the first n unlinked pairs of every space along its walk, all of them if there are fewer.

    A space numbers its pairs 0 … total − 1 and consists of blocks: (space, offset, size, a0, b0, nb)
    stands for pairs (a0 + q div nb, b0 + q mod nb) of numbered nodes, q = p − offset. The walk visits
    every number once in an order that the seed chooses, so only as many pairs are made as are asked
    for, plus those an edge rules out; a round tries the pairs after the ones before it."""
    start = int(hashlib.md5(seed.encode()).hexdigest()[:12], 16)
    tried, found = dict.fromkeys(spaces, 0), None
    open_ = {s for s, total in spaces.items() if total}
    while open_:
        rows = []
        for s in sorted(open_):
            total, until = spaces[s], min(spaces[s], max(TRIES * n, 2 * tried[s], 64))
            rows += [(s, t, min(t + CHUNK, until) - 1, Decimal(total), Decimal(start % total), Decimal(_step(total))) for t in range(tried[s], until, CHUNK)]
            tried[s] = until
        chunks = spark.createDataFrame(rows, "space string, t0 long, t1 long, total decimal(20,0), start decimal(20,0), step decimal(20,0)")
        at = chunks.repartition(max(1, min(len(rows), 2000))).withColumn("t", F.explode(F.sequence("t0", "t1")))
        at = at.withColumn("p", ((c("start") + c("t").cast("decimal(18,0)") * c("step")) % c("total")).cast("bigint")).select("space", "t", "p")
        hit = at.alias("w").join(F.broadcast(blocks).alias("k"), F.expr("w.space = k.space AND p >= offset AND p < offset + size"))
        hit = hit.select("w.space", "t", F.expr("a0 + (p - offset) DIV nb").alias("ia"), F.expr("b0 + (p - offset) % nb").alias("ib"))
        named = hit.join(nodes.select(c("index").alias("ia"), c("id").alias("a")), "ia").join(nodes.select(c("index").alias("ib"), c("id").alias("b")), "ib")
        new = cut_lineage(unlinked(named.where("a != b").select("space", "t", "a", "b"), edges))
        found = new if found is None else found.union(new)
        have = {r.space: r["count"] for r in found.groupBy("space").count().collect()}  # one row per space
        open_ = {s for s in open_ if have.get(s, 0) < n and tried[s] < spaces[s]}
    if found is None:
        return nodes.select(F.lit("").alias("space"), F.lit(0).cast("long").alias("t"), c("id").alias("a"), c("id").alias("b")).where(F.lit(False))
    return top_rank(found, ["space"], [c("t")], n)


def affinity_pairs(nodes: DataFrame, edges: DataFrame, n: int = 40, seed: str = "") -> DataFrame:
    """n pseudo-random unlinked pairs of different domains, or all there are (E10, a sampling operator).

    Nodes are numbered by domain and seeded hash; a domain's block pairs each of its nodes with every
    node of the domains after it, so each unordered pair has one number. Domains are few."""
    slim = numbered(nodes.where(c("domain").isNotNull()).select("id", "domain"), [c("domain"), F.md5(F.concat(F.lit(seed), "id")), c("id")])
    sizes = sorted(tuple(r) for r in slim.groupBy("domain").agg(F.min("index").alias("a0"), F.count(F.lit(1)).alias("n")).select("a0", "n").collect())
    whole, offset, blocks = sum(k for _, k in sizes), 0, []
    for a0, k in sizes:
        later = whole - a0 - k
        if later:
            blocks.append(("", offset, k * later, a0, a0 + k, later))
            offset += k * later
    spark = nodes.sparkSession
    table = spark.createDataFrame(blocks, "space string, offset long, size long, a0 long, b0 long, nb long")
    d = _walk(spark, {"": offset}, table, slim, edges, n, seed)
    return d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def schema_pairs(nodes: DataFrame, edges: DataFrame, schemas: DataFrame, n: int = 30, seed: str = "") -> DataFrame:
    """n unlinked pairs per schema row, or all there are (E11). schemas: (schema, from_domain, to_domain,
    from_types, to_types), type lists NULL for any; their table is small by nature."""
    def side(which, mark):
        ok = c(f"{which}_types").isNull() | F.array_contains(c(f"{which}_types"), c("entity_type"))
        d = nodes.select("id", "domain", "entity_type").join(schemas, c("domain") == c(f"{which}_domain")).where(ok)
        return d.select("schema", F.lit(mark).alias("side"), "id")

    both = numbered(side("from", 0).union(side("to", 1)), [c("schema"), c("side"), F.md5(F.concat(F.lit(seed), "id")), c("id")])
    held = {(r.schema, r.side): (r.first, r.n) for r in both.groupBy("schema", "side").agg(F.min("index").alias("first"), F.count(F.lit(1)).alias("n")).collect()}
    full = sorted(s for s, k in held if k == 0 and (s, 1) in held)
    blocks = [(s, 0, held[s, 0][1] * held[s, 1][1], held[s, 0][0], held[s, 1][0], held[s, 1][1]) for s in full]
    spark = nodes.sparkSession
    table = spark.createDataFrame(blocks, "space string, offset long, size long, a0 long, b0 long, nb long")
    d = _walk(spark, {b[0]: b[2] for b in blocks}, table, both, edges, n, seed)
    return d.select(c("space").alias("schema"), "a", "b")


def admit_affinity(pairs: DataFrame, answers: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Score lists per batch → affinity edges (E12). pairs: (batch, pos, a, b);
    answers: (batch, answer text holding a JSON array)."""
    s = answers.select("batch", F.posexplode(recover_array(c("answer"), "array<string>")).alias("pos", "score"))
    d = pairs.join(s, ["batch", "pos"]).withColumn("weight", c("score").try_cast("double")).where(c("weight") >= AFFINITY_FLOOR)
    e = d.select(F.sha2(F.concat_ws("|", F.lit("LLM_AFFINITY"), "a", "b"), 256).alias("id"), F.lit("LLM_AFFINITY").alias("relation_type"),
                 c("a").alias("from_id"), c("b").alias("to_id"), "weight", F.lit(AFFINITY_CONFIDENCE).alias("confidence"))
    return best_edges(e, nodes)


def admit_typed(pairs: DataFrame, answers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Typed answers per batch → edges (E13). vocabulary: (schema, relation)."""
    item = "array<struct<pair:string,relation:string,confidence:string>>"
    s = answers.select("batch", F.explode(recover_array(c("answer"), item)).alias("x"))
    s = s.select("batch", c("x.pair").try_cast("int").alias("pos"), c("x.relation").alias("relation"), c("x.confidence").try_cast("double").alias("confidence"))
    d = pairs.join(s.where(c("confidence") >= TYPED_FLOOR), ["batch", "pos"])
    d = d.join(vocabulary, ["schema", "relation"], "left_semi")
    e = d.select(F.sha2(F.concat_ws("|", "relation", "a", "b", "batch", "pos"), 256).alias("id"), c("relation").alias("relation_type"),
                 c("a").alias("from_id"), c("b").alias("to_id"), c("confidence").alias("weight"), "confidence")
    return best_edges(e)


def label_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Write labels back to affinity edges that have none."""
    open_ = (c("relation_type") == "LLM_AFFINITY") & F.element_at("attributes", "inferred_relation").isNull()
    d = edges.join(labels.select("id", "label"), "id", "left")
    rest = F.map_filter("attributes", lambda k, v: k != "inferred_relation")  # the key may be there without a value
    new = F.when(open_ & c("label").isNotNull(), F.map_concat(rest, F.create_map(F.lit("inferred_relation"), c("label")))).otherwise(c("attributes"))
    return d.withColumn("attributes", new).drop("label")


def build(extractions: DataFrame, nodes: DataFrame, edges: DataFrame, types: DataFrame, relations: DataFrame,
          allowed: DataFrame, scorer, schemas: DataFrame, typed_scorer, vocabulary: DataFrame, labeler) -> tuple[DataFrame, DataFrame]:
    """Full build (E16): admit → resolve → merge → dedup → typed pairs → affinity pairs → label.
    Relation ends are resolved through all tiers without a type; attributes, times and labels of
    existing edges and descriptions and tickers of existing nodes stay.

    Injected steps: `scorer` maps pairs (a, b) to (a, b, weight), `typed_scorer` maps
    (schema, a, b) to (schema, a, b, relation, confidence) and `labeler` maps edges to (id, label)."""
    ent = admit_entities(extractions, types, allowed)
    hits = resolve(ent.select(c("canonical_name").alias("name"), "entity_type"), nodes)
    ent = ent.join(hits.select(c("name").alias("canonical_name"), "entity_type", c("id").alias("known")), ["canonical_name", "entity_type"], "left")
    fresh = F.sha2(F.concat_ws("|", "entity_type", normalize_name(c("canonical_name")), F.when(normalize_name(c("canonical_name")) == "", c("canonical_name"))), 256)
    ent = cut_lineage(ent.withColumn("id", F.coalesce("known", fresh)).withColumn("sources", F.array("source_url")))
    kinds = ent.groupBy("id").agg(F.min("entity_type").alias("entity_type"), F.min("domain").alias("domain"))
    plain = [x for x in PLAIN if x in nodes.columns]
    ent = ent.withColumns({x: F.lit(None).cast(nodes.schema[x].dataType) for x in plain if x not in ent.columns})
    cols = ["id", "canonical_name", "aliases", "attributes", "sources", "confidence", *plain]
    rows = (nodes.select(*cols, F.struct(F.lit(0).alias("o"), c("id").alias("k")).alias("rank"))
            .union(ent.select(*cols, F.struct(F.lit(1).alias("o"), c("source_url").alias("k")).alias("rank"))))
    kinds = nodes.select("id", "entity_type", "domain").union(kinds.join(nodes.select("id"), "id", "left_anti"))
    all_nodes = cut_lineage(merge_rows(rows, ["id"], "rank").join(kinds, "id"))
    local = ent.select("source_url", F.explode(all_names(c("canonical_name"), c("aliases"))).alias("name"), "id").groupBy("source_url", "name").agg(F.min("id").alias("id"))
    asked = extractions.select(F.explode("relations").alias("r")).select(F.explode(F.array("r.from_entity", "r.to_entity")).alias("name")).distinct()
    new_edges = admit_relations(extractions, relations, local, resolve(asked, all_nodes).select("name", "id"))
    all_edges = cut_lineage(best_edges(_whole_edges(edges).unionByName(_whole_edges(new_edges)), all_nodes))
    final_nodes, final_edges = rewrite(all_nodes, all_edges, duplicate_map(all_nodes, all_edges))
    final_nodes, final_edges = cut_lineage(final_nodes), cut_lineage(final_edges)

    def edge(df, kind, weight, conf):
        return _whole_edges(df.select(F.sha2(F.concat_ws("|", kind, "a", "b"), 256).alias("id"), kind.alias("relation_type"), c("a").alias("from_id"),
                                      c("b").alias("to_id"), weight.alias("weight"), conf.alias("confidence")))

    typed = typed_scorer(schema_pairs(final_nodes, final_edges, schemas)).where(c("confidence") >= TYPED_FLOOR)
    typed = edge(typed.join(vocabulary, ["schema", "relation"], "left_semi"), c("relation"), c("confidence"), c("confidence"))
    linked = cut_lineage(best_edges(final_edges.unionByName(typed), final_nodes))
    scored = scorer(affinity_pairs(final_nodes, linked)).where(c("weight") >= AFFINITY_FLOOR)
    extra = edge(scored, F.lit("LLM_AFFINITY"), c("weight"), F.lit(AFFINITY_CONFIDENCE))
    links = cut_lineage(best_edges(linked.unionByName(extra), final_nodes))
    return final_nodes, label_edges(links, labeler(links.where(c("relation_type") == "LLM_AFFINITY")))


def _whole_edges(edges: DataFrame) -> DataFrame:
    """Edges with all their columns in one order; columns they lack are empty."""
    lacking = {"attributes": F.create_map().cast("map<string,string>"), "created_at": F.lit(None).cast("timestamp"), "sources": F.array().cast("array<string>")}
    have = edges.withColumns({k: v for k, v in lacking.items() if k not in edges.columns})
    return have.select("id", "relation_type", "from_id", "to_id", "weight", "confidence", "attributes", "created_at", "sources")
