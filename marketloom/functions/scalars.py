"""Column functions: symbols, numbers, text cleaning, names, JSON recovery."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .numeric import nz, rnd

# Phrases dropped from article text, legal suffixes dropped from names.
BOILERPLATE = ["Live Events", "Click here", "Subscribe to", "ET Prime",
               "Advertisement", "Expert Views", "Trending Now", "Market Wrap"]
LEGAL_SUFFIXES = "inc|ltd|llc|corp|corporation|limited|plc|gmbh|sa|nv|ag|co"
MENTION = r"\b[A-Z][A-Z0-9\-]{1,9}\b"


def strip(c: Column) -> Column:
    """White space as SQL's engine knows it; `$` would also match before a line separator that ends the text."""
    return F.regexp_replace(c, r"^[\t\n\f\r ]+|[\t\n\f\r ]+\z", "")


def feed_symbol(t: Column) -> Column:
    """Exchange-suffix mapping: indices, currencies and suffixed symbols pass untouched."""
    known = t.startswith("^") | t.endswith("=X") | t.endswith(".NS") | t.endswith(".BO")
    return F.when(known, t).otherwise(F.concat(t, F.lit(".NS")))


def clean_symbol(t: Column) -> Column:
    s = F.replace(F.upper(nz(t, "")), F.lit(".NS"), F.lit(""))
    return F.trim(F.replace(s, F.lit(".BO"), F.lit("")))


def number(t: Column) -> Column:
    """Text with thousands separators to double, NULL when it is not a number."""
    return F.replace(t, F.lit(","), F.lit("")).try_cast("double")


def clean_text(t: Column) -> Column:
    out = F.regexp_replace(nz(t, ""), r"\[\+[0-9]+\s*chars?\]", "")
    out = F.regexp_replace(out, r"\.{3,}", ".")
    for phrase in BOILERPLATE:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    return strip(out)


def title_key(t: Column) -> Column:
    return F.lower(strip(nz(t, "")))


def normalize_name(t: Column) -> Column:
    out = F.regexp_replace(F.lower(nz(t, "")), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def canonical_key(t: Column) -> Column:
    return F.trim(F.regexp_replace(normalize_name(t), rf"\b({LEGAL_SUFFIXES})\b$", ""))


def tokens(t: Column) -> Column:
    """Distinct words of the normalised text: runs of a-z and 0-9, so one pass finds them."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Token-set Jaccard of two arrays of distinct tokens, 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def naive_timestamp(t: Column) -> Column:
    """ISO text with optional trailing Z, NULL on failure."""
    return F.try_to_timestamp(F.regexp_replace(t, "Z$", ""))


def local_time(ts: Column) -> Column:
    """Market-local clock: a fixed shift of five and a half hours."""
    return ts + F.expr("INTERVAL '05:30' HOUR TO MINUTE")


def market_open(ts: Column, until: int = 16) -> Column:
    t = local_time(ts)
    return (F.weekday(t) < 5) & (F.hour(t) >= 9) & (F.hour(t) < until)


def age_seconds(ts: Column, now: Column) -> Column:
    return F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))


def to_crores(x: Column) -> Column:
    return rnd(x / 1e7, 2)


def mentions(docs: DataFrame, vocabulary: DataFrame, doc: str, text: str, k: int = 4) -> DataFrame:
    """First k distinct known symbols per text, in order (P10); vocabulary has a `symbol` column."""
    found = docs.select(doc, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(MENTION), 0)).alias("pos", "symbol"))
    first = found.join(vocabulary.select("symbol"), "symbol", "left_semi").groupBy(doc, "symbol").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy(doc).orderBy("pos")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def outer_braces(t: Column, opening: str = "{", closing: str = "}") -> Column:
    """Text from the first opening to the last closing mark, fences dropped."""
    plain = F.regexp_replace(t, r"```(?:json)?\s*", "")
    return F.regexp_extract(plain, rf"(?s)\{opening}.*\{closing}", 0)


def recover_json(t: Column, schema: str) -> Column:
    """Object hidden in model text; a second try drops control characters."""
    body = outer_braces(t)
    again = F.regexp_replace(body, r"[\x00-\x1f\x7f]", "")
    strict = {"mode": "PERMISSIVE", "allowUnquotedControlChars": "false"}
    parsed = F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, schema, strict))
    return F.coalesce(parsed, F.from_json(again, schema, strict))


def recover_array(t: Column, schema: str = "array<double>") -> Column:
    return F.from_json(outer_braces(t, "[", "]"), schema)


def all_names(name: Column, aliases: Column) -> Column:
    return F.filter(F.concat(F.array(name), aliases), lambda x: x != "")


def sorted_values(attributes: Column) -> Column:
    """Attribute values in key order, so that text built from a map is deterministic."""
    return F.transform(F.array_sort(F.map_entries(attributes)), lambda e: e["value"])


def node_text(name: Column, kind: Column, ticker: Column, aliases: Column, description: Column,
              attributes: Column) -> Column:
    parts = F.concat(F.array(name, kind, ticker), aliases, F.array(description), sorted_values(attributes))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " | ")


def short_label(t: Column) -> Column:
    return F.when(F.length(t) > 22, F.concat(F.left(t, F.lit(20)), F.lit("…"))).otherwise(t)


def edge_label(relation: Column, inferred: Column) -> Column:
    return F.coalesce(inferred, F.lower(F.replace(relation, F.lit("_"), F.lit(" "))))


def first_attributes(attributes: Column, k: int) -> Column:
    return F.array_join(F.transform(F.slice(F.array_sort(F.map_entries(attributes)), 1, k),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def snippet(name: Column, kind: Column, domain: Column, attributes: Column) -> Column:
    return F.concat(name, F.lit(" ("), kind, F.lit("/"), domain, F.lit(") "), first_attributes(attributes, 3))
