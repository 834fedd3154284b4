"""All stages in a row against plain versions of each, on a small folder of documents and labels."""
import base64
import hashlib
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken
from llm.helpers import copies, groups, words
from marketloom.llm import mixing, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, quality_score string, copy_digest string, kept_id string"


def folder(spark, path):
    rng, rows, labels = random.Random(12), [], []
    for i in range(240):
        w = ["".join(rng.choice("abcdeionst") for _ in range(rng.randrange(2, 10))) for _ in range(rng.randrange(40, 160))]
        good = i % 4 > 0
        rows.append((i, " ".join(w) + "." if good else "!! ".join(x.upper() for x in w[:9] * 8), "en", f"s{i % 3}" if i % 9 else None))
        labels.append((i, int(good), 0))
    for i in range(1, 40, 4):  # exact and near copies of good documents
        rows.append((1000 + i, "  " + rows[i][1].replace(" ", "\n", 3), "en", "s1"))
        w = rows[i + 1][1].split()
        rows.append((2000 + i, " ".join([*w[:len(w) // 2], "changed", *w[len(w) // 2 + 1:]]), "en", "s2"))
    spark.createDataFrame([(*r, len(r[1]), "q", "d", "k") for r in rows], DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {r[0]: r for r in rows}


def test_stages_equal_plain_versions(spark, tmp_path):
    path = str(tmp_path)
    rows, seen = folder(spark, path), {}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        seen[name] = docs.collect()
        assert k == 4 or docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "mixing", "byte_bpe"]
    good = {i for i in rows if i >= 1000 or i % 4}
    kept = {r.doc_id for r in seen["quality_classifier"]}
    assert len(good ^ kept) <= 4  # the classifier's own errors
    kept = {k for k, _ in copies([(i, rows[i][1]) for i in kept]).values()}
    assert {r.doc_id for r in seen["exact_dedup"]} == kept
    near = groups([(i, rows[i][1]) for i in kept], 5, 80)
    assert {r.doc_id for r in seen["minhash_near_dedup"]} == {root for _, root in near.values()} and len({root for _, root in near.values()}) < len(kept)
    sized = mixing.sizes(spark.createDataFrame(seen["minhash_near_dedup"], DOCS))
    target = {r.source: r.target for r in mixing.targets(sized.select("source", "size")).collect()}
    taken = Counter()
    for r in seen["mixing"]:
        taken[r.source] += len(words(r.text))
        assert rows[r.doc_id][1].startswith(r.text)
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.RANKS), "rb"))}
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in seen["mixing"]:
        ids = library.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(map(tuple, seen["byte_bpe"])) == sorted(want)


def test_stages_on_an_empty_table(spark, tmp_path):
    path = str(tmp_path)
    docs = spark.createDataFrame([], DOCS)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.count() == 0
