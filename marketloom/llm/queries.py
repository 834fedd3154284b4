"""The operators with production parameters over their whole tables, and their SQL."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, exact_dedup, language_model, mixing, near_dedup, passages, quality_model, quality_rules, token_counts, toxicity, url_filter, whitening
from .common import stored

RANKS, MODEL = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM sources),
weighed AS (SELECT *, [3, 1, 2][(r - 1) % 3 + 1] AS weight FROM ranked),
levels AS (SELECT *, ((sum(source_size) OVER ())::BIGINT * 150 / 100.0::DOUBLE
    - coalesce(sum(source_size) OVER up, 0)::BIGINT * 2) / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER up, 0)::BIGINT) AS level
  FROM weighed WINDOW up AS (ORDER BY source_size * 2 / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
budget AS (SELECT source, source_size, least((source_size * 2)::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
placed AS (SELECT d.doc_id, d.size, b.source_size, b.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    CASE WHEN b.source_size > 0 THEN floor(floor(b.target) / b.source_size)::BIGINT ELSE 0 END AS epochs
  FROM sized d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM placed"""


@query(MIX_SQL)
def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mixture of all sources at weights 3, 1, 2 takes from each document."""
    sized = stored(mixing.sizes(table(spark, folder, "documents")), "sizes")
    return mixing.plan(sized).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every whole text by the byte-level vocabulary of the tokenizers library."""
    docs = table(spark, folder, "documents").select("doc_id", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"), "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path(MODEL), public_tokenizers.PATTERN)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query()
def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every whole text's ids and of the bytes that the ids decode to."""
    return bpe_digests(table(spark, folder, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    return byte_bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


COPIES_SQL = r"""
WITH rows AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS whole FROM documents),
ranked AS (SELECT *, first_value(doc_id) OVER best AS keep_id, row_number() OVER best AS place, count(*) OVER (PARTITION BY whole) AS group_size
  FROM rows WINDOW best AS (PARTITION BY whole ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, place = 1 AS kept, sha256(whole) AS text_sha256 FROM ranked"""


@query(COPIES_SQL)
def op10_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the equal one that stays."""
    found = exact_dedup.find_copies(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query()
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learnt without the held-out third."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    scored = quality_model.score_all(table(spark, folder, "documents"), table(spark, folder, "labels"), "quality", held_out)
    return judged(scored, held_out)


def judged(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
windows AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
found AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM windows),
repeated AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM found WHERE c > 1) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
counts AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN repeated ON w.rid = repeated.rid LEFT JOIN lines ON w.rid = lines.rid),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
measures AS (SELECT rid, lang, source, base_failed, unnest(['mean_word', 'symbols', 'dup_lines', 'repeats']) AS name,
  unnest([1000 * word_chars // n_words, 1000 * n_symbols // n_words, 1000 * n_dup_lines // n_words, 1000 * n_repeat_words // n_words]) AS m FROM base WHERE n_words > 0),
cells AS (SELECT lang, source, name, (m >> greatest(length(bin(m)) - 7, 0)) << greatest(length(bin(m)) - 7, 0) AS cell FROM measures WHERE NOT base_failed),
counted AS (SELECT lang, source, name, cell, count(*) AS n FROM cells GROUP BY ALL),
levels AS (SELECT 2 AS level, lang, name, cell, sum(n) AS n FROM counted GROUP BY ALL UNION ALL SELECT 3, NULL, name, cell, sum(n) FROM counted GROUP BY name, cell),
parts AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, name ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY level, lang, name) AS total FROM levels),
points AS (SELECT level, lang, name, p, min(cell) AS cell FROM parts, (SELECT unnest(range(5, 100, 10)) AS p) WHERE upto * 100 >= total * p GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source, name FROM counted),
blended AS (SELECT * FROM counted UNION ALL SELECT g.lang, g.source, g.name, cell, CASE level WHEN 2 THEN 5 ELSE 1 END
  FROM groups g JOIN points p ON g.name = p.name AND (level = 3 OR g.lang IS NOT DISTINCT FROM p.lang)),
merged AS (SELECT lang, source, name, cell, sum(n) AS n FROM blended GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, name ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY lang, source, name) AS total FROM merged),
quartiles AS (SELECT lang, source, name, min(cell) FILTER (upto * 100 >= total * 25) AS low, min(cell) FILTER (upto * 100 >= total * 50) AS mid,
  min(cell) FILTER (upto * 100 >= total * 75) AS high FROM ranked GROUP BY ALL),
fences AS (SELECT lang, source, name, CASE WHEN name = 'mean_word' THEN mid - 4 * greatest(high - mid, least_spread) ELSE 0 END AS at_least, mid + 4 * greatest(mid - low, least_spread) AS at_most
  FROM quartiles JOIN (VALUES ('mean_word', 300), ('symbols', 50), ('dup_lines', 25), ('repeats', 75)) AS f(name, least_spread) USING (name)),
judged AS (SELECT m.rid, bool_and(m.m >= f.at_least AND m.m <= f.at_most) AS inside
  FROM measures m JOIN fences f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source AND m.name = f.name
  GROUP BY m.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, false) AS kept
FROM base LEFT JOIN judged ON base.rid = judged.rid"""


@query(RULES_SQL)
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of every document and the verdict of the adaptive fences."""
    found = quality_rules.verdicts(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document, learnt without the held-out fifth."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = toxicity.score_all(table(spark, folder, "documents"), table(spark, folder, "labels"), "toxic", held_out)
    return judged(scored, held_out)


URL_SQL = r"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(h, p, v)),
rest AS (SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parsed AS (SELECT *, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
found AS (SELECT page_id, url, host, unnest([
    regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?i)url\s*=\s*["'']?([^"''\s>]+)', 1)]) AS t FROM parsed),
targets AS (SELECT url AS x, CASE WHEN contains(t, '://') THEN t WHEN t LIKE '//%' THEN split_part(url, '://', 1) || ':' || t
  WHEN t LIKE '/%' THEN split_part(url, '://', 1) || '://' || host || t ELSE regexp_extract(url, '^([^?#]*/)?') || t END AS y FROM found WHERE t <> ''),
addresses AS (SELECT DISTINCT u, substr(u, strpos(u, '://') + 3) AS r FROM (SELECT url AS u FROM parsed UNION ALL SELECT y FROM targets) WHERE contains(u, '://')),
split AS (SELECT u, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
  regexp_replace(regexp_replace(regexp_extract(r, '^[^?#]*\?([^#]*)', 1), '(^|&)(utm_[^=&]*|gclid|fbclid|ref)(=[^&]*)?', '', 'g'), '^&', '') AS q FROM addresses),
nodes AS (SELECT u, host, path, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS node FROM split WHERE host <> ''),
fits AS (SELECT u, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM nodes JOIN rules
  ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY u),
edges AS (SELECT DISTINCT a.node AS x, b.node AS y FROM targets JOIN nodes a ON targets.x = a.u JOIN nodes b ON targets.y = b.u WHERE a.node <> b.node),
either AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
blocked(node) AS (SELECT node FROM nodes JOIN fits ON nodes.u = fits.u WHERE verdict = 'block' AND node IN (SELECT x FROM either)
  UNION SELECT y FROM blocked JOIN either ON node = x)
SELECT page_id, parsed.host, parsed.path, rule,
  CASE WHEN rule IS NOT NULL THEN verdict WHEN nodes.node IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM parsed LEFT JOIN fits ON parsed.url = fits.u LEFT JOIN nodes ON parsed.url = nodes.u"""


@query(URL_SQL)
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's address by rules and by its redirect and canonical aliases."""
    return url_filter.judge(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query()
def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the least doc_id of its group of near-duplicates."""
    found = near_dedup.find_groups(table(spark, folder, "documents"), 3, 85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@query()
def op5_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of at least 50 words that repeat, exactly or nearly, in another document."""
    found = passages.repeated_passages(table(spark, folder, "documents"))
    return found.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "source_id",
                        F.col("source_start").alias("source_start_word"), F.col("source_end").alias("source_end_word"), "similarity")


def centroids_sql(k: int, rounds: int, seed: int, dim: int) -> str:
    """The rounds of the clustering one after the other, on one row per vector and component."""
    parts = [f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim}),
xs AS MATERIALIZED (SELECT rid, unnest(range({dim})) AS d, floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM kept),
starts AS (SELECT rid, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, ''))) - 1 AS j FROM kept ORDER BY j LIMIT {k}),
c0 AS MATERIALIZED (SELECT j, d, x AS c FROM starts JOIN xs USING (rid))"""]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (SELECT rid, arg_min(j, struct_pack(q := q, j := j)) AS j, min(q) AS q
  FROM (SELECT rid, j, sum((x - c) * (x - c))::BIGINT AS q FROM xs JOIN c{t} USING (d) GROUP BY rid, j) GROUP BY rid)""")
        if t < rounds:
            parts.append(f"""m{t} AS (SELECT j, d, sum(x)::BIGINT AS s, count(*) AS n FROM xs JOIN a{t} USING (rid) GROUP BY j, d),
c{t + 1} AS MATERIALIZED (SELECT c.j, c.d, CASE WHEN m.n IS NULL THEN c.c ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS c FROM c{t} c LEFT JOIN m{t} m ON c.j = m.j AND c.d = m.d)""")
    return ",\n".join(parts) + f"""
SELECT vec_id, j::INTEGER AS cluster, q AS distance, (sum(q) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(q) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN (SELECT j, sha256(string_agg(c::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY j) USING (j)"""


@query(centroids_sql(8, 10, 3, 64))
def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster, exact distance and centroid digest of every vector after ten rounds."""
    return centroids.cluster(table(spark, folder, "embeddings"), 8, 10, 3, 64)


@query()
def op12_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every whole text under a recurrent model learnt without the held-out tenth."""
    return language_model.score_all(table(spark, folder, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


@query()
def op13_whitened_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the eight strongest components at unit variance."""
    found = whitening.whiten(table(spark, folder, "embeddings"), 8)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))  # null beyond 64 bits
