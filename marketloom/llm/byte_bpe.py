"""Byte-level BPE encoding and decoding with a local rank file, through the tiktoken library.

A text is encoded match by match of a splitting pattern. Long texts are cut first, only where the
pattern always ends a match (a space between two letters) and around very long runs of white
space, which the library's pattern engine cannot match; pieces stay small and ids stay the same.
Ids are decoded to raw bytes, as one id need not be a whole character.

`encode` and `decode` give ids and bytes as columns; `digests` encodes and decodes text by text in one
pass and returns four small columns, so no list of ids leaves a worker.

Null texts encode as empty texts, to no ids; ids of null decode to no bytes. Repeated rows are rows of
their own, an empty table gives an empty table. Extra columns pass through untouched; an earlier column
with the name of the result is replaced.
"""
from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts above this many characters are cut; pieces are about this long.
PIECE = 50_000
#: A run of white space from this length on is encoded as pieces of its own.
LONG_RUN = 10_000
#: Texts of about this many characters leave a task as one batch.
BATCH = 2_000_000
#: Unicode's white space.
_WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_RUN = regex.compile("[%s]{%d,}" % (_WHITE, LONG_RUN))
_SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")


#: A pattern that takes a whole text as one match.
WHOLE = r"[\s\S]+"


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The library's encoder for a rank file, built once for each worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _whole(enc: tiktoken.Encoding) -> tiktoken.Encoding:
    """The same vocabulary for pieces that are one match; built only where a text has such a piece."""
    ranks = {enc.decode_single_token_bytes(i): i for i in range(enc.n_vocab)}
    return tiktoken.Encoding("whole", pat_str=WHOLE, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE) -> list[tuple[str, bool]]:
    """Pieces of a text and whether each is one match of the pattern; encoding them one by one gives the same ids."""
    out, at = [], 0

    def cut(start: int, end: int) -> None:
        while end - start > size:
            found = _SAFE.search(text, start + size, end)
            if not found:
                break
            out.append((text[start:found.start()], False))
            start = found.start()
        if start < end:
            out.append((text[start:end], False))

    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))  # the last space belongs to what follows
        cut(at, run.start())
        out.append((text[run.start():end], True))
        at = end
    cut(at, len(text))
    return out


def encode_pieces(enc: tiktoken.Encoding, text: str):
    """The ids of a text, piece by piece."""
    if len(text) <= LONG_RUN:
        yield enc.encode_ordinary(text)
        return
    for piece, whole in safe_pieces(text):
        yield (_whole(enc) if whole else enc).encode_ordinary(piece)


def encode_text(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    return np.array([i for ids in encode_pieces(enc, text) for i in ids], dtype=np.int32)


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids joined by a space) and decoded_sha256 (bytes that the ids decode to) of every text."""
    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for text in batch.column(1):
                n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                for ids in encode_pieces(enc, text.as_py() or ""):
                    if ids:
                        a.update((" " if n else "").encode() + " ".join(map(str, ids)).encode())
                        b.update(enc.decode_bytes(ids))
                        n += len(ids)
                counts.append(n)
                coded.append(a.hexdigest())
                decoded.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _by_size(batch: pa.RecordBatch, sizes: np.ndarray, limit: int):
    """Row ranges of a batch that hold about limit of the sizes each."""
    group = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip(np.r_[0, edges], np.r_[edges, len(sizes)]):
        if a < b:
            yield batch.slice(int(a), int(b - a))


def _lists(parts: list[np.ndarray], value_type: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=value_type))


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the token ids of each whole text as an array of integers."""
    docs = docs.drop(ids) if ids in docs.columns and ids != text else docs
    at = docs.columns.index(text)

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(at).fill_null("").to_pylist()], dtype=np.int64)
            for part in _by_size(batch, sizes, BATCH):
                found = [encode_text(enc, x or "") for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(found, pa.int32())], [*part.schema.names, ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, rank_file: str, pattern: str, ids: str = "ids", raw: str = "raw") -> DataFrame:
    """encoded with the bytes that each row's ids stand for."""
    encoded = encoded.drop(raw) if raw in encoded.columns and raw != ids else encoded
    at = encoded.columns.index(ids)

    def run(batches):
        enc = encoding(rank_file, pattern)
        table = [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]
        for batch in batches:
            sizes = np.array(pc.list_value_length(batch.column(at)).fill_null(0), dtype=np.int64)
            for part in _by_size(batch, sizes, BATCH):
                found = [b"".join(map(table.__getitem__, x)) if x else b"" for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, raw])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(raw, T.BinaryType())]))
