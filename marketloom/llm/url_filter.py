"""URL filters whose block decisions reach the aliases of a page.

A rule names a host and a path prefix; it fits the host and its subdomains, and the longest fitting
rule decides. Pages and the targets of their redirects (meta refresh) and canonical links form an
undirected graph; addresses that differ only by scheme, fragment or tracking parameters are one
node. Connected components of that graph are aliases of each other. A page without a rule of its
own is blocked if any address of its component is blocked by a rule; a page that a rule allows stays
allowed. Everything else is allowed.

Host suffixes are matched by an equality join, so the work does not depend on the number of rules. A
null url or one without "://" has an empty host and path, fits no rule and has no alias; null html has
no links. Every page row gets its own verdict; extra columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

#: (host, path, verdict) of the production rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"(^|&)(utm_[^=&]*|gclid|fbclid|ref)(=[^&]*)?"


def after_scheme(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://(.*)$", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "(?s)^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "(?s)^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """Address without scheme, fragment and tracking parameters; null without a host."""
    query = F.regexp_extract(after_scheme(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    plain = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&", "")
    node = F.concat(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)), F.when(plain == "", "").otherwise(F.concat(F.lit("?"), plain)))
    return F.when(host_of(url) != "", node)


def links(pages: DataFrame) -> DataFrame:
    """(url, target): canonical links and redirects, made absolute."""
    canonical = F.regexp_extract("html", r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    refresh = F.regexp_extract("html", r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    targets = F.array(F.regexp_extract(canonical, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1), F.regexp_extract(refresh, r"""(?i)url\s*=\s*["']?([^"'\s>]+)""", 1))
    found = pages.filter(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.explode(targets).alias("t")).filter("t != ''")
    scheme = F.regexp_extract("url", "(?s)^(.*?)://", 1)
    whole = (F.when(F.col("t").contains("://"), F.col("t")).when(F.col("t").startswith("//"), F.concat(scheme, F.lit(":"), F.col("t")))
             .when(F.col("t").startswith("/"), F.concat(scheme, F.lit("://"), host_of(F.col("url")), F.col("t")))
             .otherwise(F.concat(scheme, F.lit("://"), host_of(F.col("url")), F.regexp_extract(path_of(F.col("url")), "^(.*/)?", 0), F.col("t"))))
    return found.select("url", whole.alias("target"))


def with_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """urls (with host and path) with rule and rule_verdict of the longest fitting rule, or nulls."""
    spark = urls.sparkSession
    table = spark.createDataFrame([(h, p, v, h + p) for h, p, v in rules], "rule_host string, rule_path string, v string, r string")
    names = urls.columns
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    fits = hosts.join(table, (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("r"), F.when(F.col("v") == "allow", 1).otherwise(0), "r", "v")).alias("x"))
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), F.col("x.r").alias("rule"), F.col("x.v").alias("rule_verdict"))
    best = stored(best, "fitting-rules")
    return urls.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left").select(*names, "rule", "rule_verdict")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and blocked_by_alias of every page."""
    addressed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    judged = with_rules(addressed, rules)
    edges = links(pages.select("url", "html")).select(F.col("url").alias("from_url"), "target")
    edges = edges.select(node_of(F.col("from_url")).alias("x"), node_of(F.col("target")).alias("y")).filter("x != y").distinct()
    blocked = stored(blocked_aliases(stored(edges, "alias-edges"), rules), "blocked-aliases")
    out = judged.join(blocked.withColumnRenamed("node", "alias"), F.col("node") == F.col("alias"), "left")
    by_alias = F.col("rule").isNull() & F.col("alias").isNotNull()
    return out.select("page_id", "host", "path", "rule", F.when(by_alias, "block").otherwise(F.coalesce("rule_verdict", F.lit("allow"))).alias("verdict"), by_alias.alias("blocked_by_alias"))


def blocked_aliases(edges: DataFrame, rules=RULES) -> DataFrame:
    """Nodes of edges (x, y) in whose component a rule blocks some node."""
    names = stored(edges.select(F.col("x").alias("name")).union(edges.select("y")).distinct().withColumn("id", F.monotonically_increasing_id()), "alias-nodes")
    a, b = names.select(F.col("name").alias("x"), F.col("id").alias("a")), names.select(F.col("name").alias("y"), F.col("id").alias("b"))
    label = components(edges.join(a, "x").join(b, "y").select("a", "b"))
    url = F.concat(F.lit("http://"), F.col("name"))
    judged = with_rules(names.select("id", "name", host_of(url).alias("host"), path_of(url).alias("path")), rules)
    known = stored(judged.join(label, F.col("id") == F.col("node")).select("name", "component", (F.col("rule_verdict") == "block").alias("hit")), "alias-labels")
    bad = stored(known.filter("hit").select("component").distinct(), "blocked-components")
    return known.join(bad, "component", "left_semi").select(F.col("name").alias("node"))
