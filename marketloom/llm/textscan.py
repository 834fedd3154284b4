"""Words of a batch of texts as numpy arrays, without a Python object for each word."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are scanned in runs of about this many bytes; a longer text is cut at white space.
RUN = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n, modulo 2 to the 64."""
    if base not in _powers or len(_powers[base]) <= n:
        steps = np.full(max(n, RUN + 1) + 1, base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of n texts in order: text number, first and end byte in data, 64-bit value."""

    n: int
    data: np.ndarray
    edges: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    value: np.ndarray

    def first(self) -> np.ndarray:
        """Position of each text's first word; one more entry for the end."""
        return np.searchsorted(self.text, np.arange(self.n + 1))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 places where they begin."""
    texts = texts.fill_null("").cast(pa.large_binary())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]] if data else np.empty(0, np.uint8)
    return data, edges - edges[0]


def scan(texts: pa.Array, lower: bool = False) -> Words:
    data, edges = flat(texts)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    before = np.append(True, space)
    before[edges] = True
    starts = np.flatnonzero(~space & before[:len(data)])
    nxt = np.append(space[1:], True)[:len(data)]
    nxt[edges[1:][edges[1:] > 0] - 1] = True
    ends = np.flatnonzero(~space & nxt) + 1
    text = np.searchsorted(edges, starts, "right") - 1
    return Words(len(texts), data, edges, text.astype(np.int32), starts, ends, _values(data, starts, ends))


def _values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial values of the words, run by run so that the sums stay small in memory."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + RUN, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * _power(_BASE, high - low)[:high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * _power(_BACK, high - low)[s] ^ (e - s).astype(np.uint64))
        at = to
    return out


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all k-word sequences inside a text, and the position of their first word."""
    n = len(words.value) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(words.text[:n] == words.text[k - 1:])
    value = np.zeros(len(at), np.uint64)
    for i in range(k):
        value = mix(value * np.uint64(0xD6E8FEB86659FD93) + words.value[at + i] + np.uint64(i + 1))
    return value, at


def slices(batch: pa.RecordBatch, column: int, limit: int = RUN):
    """Row ranges of a batch with about limit bytes of text each, in order."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    group = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip(np.r_[0, edges], np.r_[edges, len(sizes)]):
        if a < b:
            yield batch.slice(int(a), int(b - a))
