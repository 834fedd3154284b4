"""Token counts of whole texts as the tokenizers library gives them, mostly without merging.

Most words of a text are whole tokens. `whole_tokens` proves once, from the vocabulary alone, which
strings encode to exactly one token when they stand alone; a text is then split into the pieces
that are merged separately, a proved piece counts 1 at once, and only the other pieces go through
the library's merges (each once for every worker while the memory of pieces lasts).

The splitting pattern is run here by another engine than the library's, so it is trusted only on
characters for which both agree (Basic Latin to Latin Extended-B, general punctuation and a few
symbols, `FAST`). Texts with any other character, and texts that contain a special string, are
counted by the library itself. Null and empty texts have 0 tokens.
"""
from __future__ import annotations

import functools

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

#: Pieces whose counts a worker remembers.
REMEMBER = 500_000
#: Pieces longer than this are counted and not remembered.
LONG_PIECE = 64
#: Characters on which both pattern engines give the same split.
FAST_RANGES = ((0x20, 0x7E), (0xA0, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC), (0x2122, 0x2122))
FAST = regex.compile(r"[\t\n\r" + "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in FAST_RANGES) + "]*")


def whole_tokens(tokenizer: Tokenizer, pattern: str) -> list[str]:
    """Vocabulary strings that are one piece of the pattern and encode alone as one token."""
    table = byte_letters()
    found = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        try:
            found.append(bytes(table[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):  # part of a character only
            continue
    one = regex.compile(pattern)
    found = [x for x in found if FAST.fullmatch(x) and one.fullmatch(x)]
    sizes = (len(e.ids) for e in tokenizer.encode_batch(found, add_special_tokens=False))
    return [x for x, n in zip(found, sizes) if n == 1]


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pieces(dict):
    """Token counts of pieces; unknown pieces are merged by the library."""

    def __init__(self, tokenizer: Tokenizer, pattern: str):
        super().__init__((x, 1) for x in whole_tokens(tokenizer, pattern))
        self.tokenizer, self.limit = tokenizer, len(self) + REMEMBER

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONG_PIECE:
            if len(self) >= self.limit:
                for key in [k for k, v in self.items() if v > 1]:
                    del self[key]
            self[piece] = n
        return n


@functools.lru_cache(maxsize=2)
def counter(model_file: str, pattern: str):
    tokenizer = Tokenizer.from_file(model_file)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    pieces, split = Pieces(tokenizer, pattern), regex.compile(pattern).findall

    def count(text: str | None) -> int:
        if not text:
            return 0
        if FAST.fullmatch(text) and not any(s in text for s in specials):
            return sum(map(pieces.__getitem__, split(text)))
        return len(tokenizer.encode(text, add_special_tokens=False).ids)

    return count


def count_tokens(docs: DataFrame, model_file: str, pattern: str, text: str = "text", n: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each whole text in place of the text."""
    docs = docs.drop(n) if n in docs.columns and n != text else docs
    at = docs.columns.index(text)
    rest = [i for i, c in enumerate(docs.columns) if c != text]

    def run(batches):
        count = counter(model_file, pattern)
        for batch in batches:
            found = pa.array([count(x.as_py()) for x in pc.fill_null(batch.column(at), "")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), found], [*(batch.schema.names[i] for i in rest), n])

    return docs.mapInArrow(run, T.StructType([*(docs.schema.fields[i] for i in rest), T.StructField(n, T.LongType())]))
