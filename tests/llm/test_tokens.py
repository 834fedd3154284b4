import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from conftest import SMALL
from llm.helpers import awkward, empty
from marketloom.llm import byte_bpe, queries, token_counts
from tokenizers import Tokenizer

MODEL, RANKS, PATTERN = public_tokenizers.path(queries.MODEL), public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
TEXTS = ["", "<|endoftext|>", "a<|endoftext|> b", "it's  we'll   \n\n x", "日本 語 text", "x\x1cy\x85z", "՘ armenian ꟏", "tail   ", " \n\t ", "é à", "a" * 3000, "!?" * 900]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(spark):
    docs = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    return docs[:80] + TEXTS


def test_counts_equal_the_library(spark):
    t = Tokenizer.from_file(MODEL)
    count = token_counts.counter(MODEL, PATTERN)
    for x in texts(spark):
        assert count(x) == len(t.encode(x, add_special_tokens=False).ids), x[:50]
    assert count(None) == 0


def test_proved_pieces_are_single_tokens():
    t = Tokenizer.from_file(MODEL)
    proved = token_counts.whole_tokens(t, PATTERN)
    assert len(proved) > 40_000 and all(len(e.ids) == 1 for e in t.encode_batch(proved[::50], add_special_tokens=False))


def test_ids_equal_the_library_and_decode_to_the_text(spark, library):
    rows = [(i, x) for i, x in enumerate([*texts(spark), None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    coded = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    for r in coded:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.raw) == (r.text or "").encode()
    digests = {r.doc_id: r for r in queries.bpe_digests(docs).collect()}
    for i, x in rows:
        ids = library.encode_ordinary(x or "")
        assert digests[i].n_tokens == len(ids) and digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest()


def test_long_texts_are_cut_safely(library):
    words = " ".join(f"word{i} it's {i}!?\n\n  x" for i in range(30_000))
    assert len(byte_bpe.safe_pieces(words)) > 5 and byte_bpe.encode_text(library, words).tolist() == library.encode_ordinary(words)
    for x in ("a" + " " * 30_000 + "b", "\n" * 20_000, "\t" * 15_000 + " c d" * 20_000):
        assert byte_bpe.encode_text(library, x).tolist() == library.encode_ordinary(x)
    huge = " " * 1_200_000 + "end"  # more than the library's pattern engine can take
    assert library.decode_bytes(byte_bpe.encode_text(library, huge).tolist()) == huge.encode()


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert token_counts.count_tokens(docs, MODEL, PATTERN).count() == docs.count()
    clash = byte_bpe.encode(docs.withColumnRenamed("size", "ids"), RANKS, PATTERN)
    assert clash.count() == docs.count() and dict(clash.dtypes)["ids"] == "array<int>"
    assert byte_bpe.decode(byte_bpe.encode(empty(spark), RANKS, PATTERN), RANKS, PATTERN).count() == 0
    assert token_counts.count_tokens(empty(spark), MODEL, PATTERN).count() == 0
