"""Toxicity of documents by a support vector machine over a gapped subsequence kernel.

The kernel of two words sums over all three-letter subsequences that both hold, each weighted by
`DECAY` to the power of the letters it spans, and is normalised; punctuation only stretches a span, and
letters put between those of an insult, or endings added to it, only lower the value. Units are the words of a sentence without
outer punctuation (longer ones in overlapping windows) and runs of single letters joined together.

Training: every sentence of a clean document is clean; a unit is a likely insult if documents with
the label hold it far more often than documents without, and so many of them that chance would hardly give
one such unit among all; how common other units are does not matter. Landmarks are the strongest such units;
units are mapped to the landmarks' space (Nyström) and a linear machine with squared hinge is
solved there by Newton steps, with variants of the positives that have characters inserted, and
with the worst clean units of all training documents added round by round. At most `MAX_ROWS`
labelled documents (those with the smallest hashes) are used; that is the only bound.

A linear function of kernel values with fixed landmarks is itself a weight for each three-letter
subsequence. Scoring adds up this table over a unit's subsequences, which gives the same value as
the kernels would. A document scores as its worst unit; the zero of the score splits the training
documents with the fewest errors. Null and empty texts, and all texts when no label is toxic, score
as clean. Null labels are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan
from .common import stored

#: Labelled documents, landmarks, positive and clean units of the machine, rounds of adding worst clean units.
MAX_ROWS, LANDMARKS, POSITIVES, CLEAN, ROUNDS = 40_000, 64, 1_000, 8_000, 3
#: Documents that must hold a likely insult, how much likelier it must be under the label, and how many units may pass by chance.
MIN_DOCUMENTS, MIN_RATIO, BY_CHANCE = 3, 20.0, 0.05
DECAY, PENALTY, CLEAN_WEIGHT, SOFT, BINS = 0.7, 100.0, 1.0, 1.0, 4000
#: Longest unit in bytes; longer words are taken in windows that overlap by half.
LONGEST = 24
KINDS = 64
_KIND = np.zeros(256, np.uint8)  # 0: punctuation
_KIND[0x30:0x3A] = 1
_KIND[0x61:0x7B] = np.arange(2, 28)
_KIND[0x41:0x5B] = np.arange(2, 28)
_KIND[0x80:] = 28 + (np.arange(0x80, 0x100) & 0x1F)


def _windows(start: np.ndarray, end: np.ndarray, owner: np.ndarray):
    """Spans of at most LONGEST bytes that cover the given spans, with their owners."""
    step = LONGEST // 2
    parts = np.maximum(1, -(-(end - start - step) // step))
    which = np.repeat(np.arange(len(start)), parts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    s = start[which] + nth * step
    return s, np.minimum(s + LONGEST, end[which]), owner[which]


def letters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Matrix of kinds of the bytes of each span; 255 after the end."""
    width = int((end - start).max(initial=3))
    at = start[:, None] + np.arange(max(width, 3))
    inside = at < end[:, None]
    return np.where(inside, _KIND[data[np.minimum(at, max(len(data) - 1, 0))]], 255).astype(np.uint8)


def _triples(kinds: np.ndarray):
    """(rows, code, weight exponent) for each choice of three places."""
    width = kinds.shape[1]
    wide, size = kinds.astype(np.int32), (kinds != 255).sum(1)
    for k in range(2, width):
        rows = np.flatnonzero(size > k)
        if not len(rows):
            return
        rows = rows[wide[rows, k] > 0]
        own = wide[rows]
        for i in range(k - 1):
            first = own[:, i] * (KINDS * KINDS) + own[:, k]
            for j in range(i + 1, k):
                whole = (own[:, i] > 0) & (own[:, j] > 0)
                if whole.all():
                    yield rows, first + own[:, j] * KINDS, k - i + 1
                elif whole.any():
                    yield rows[whole], (first + own[:, j] * KINDS)[whole], k - i + 1


def spectrum(kinds: np.ndarray) -> np.ndarray:
    """Weights of all three-letter subsequences of a few units, one row each."""
    out = np.zeros((len(kinds), KINDS ** 3), np.float32)
    for rows, code, span in _triples(kinds):
        out[rows, code] += DECAY ** span
    return out


def norms(kinds: np.ndarray) -> np.ndarray:
    """Square roots of the kernel of each unit with itself, by the usual recursion over prefixes."""
    n, width = kinds.shape
    valid = (kinds != 255) & (kinds != 0)
    same = (kinds[:, :, None] == kinds[:, None, :]) & valid[:, :, None] & valid[:, None, :]
    before = np.ones((n, width + 1, width + 1))
    d2 = DECAY * DECAY
    for _ in range(2):
        here = np.zeros((n, width + 1, width + 1))
        for a in range(width):
            run = np.zeros(n)
            for b in range(width):
                run = DECAY * run + np.where(same[:, a, b], d2 * before[:, a, b], 0.0)
                here[:, a + 1, b + 1] = DECAY * here[:, a, b + 1] + run
        before = here
    total = np.where(same, d2 * before[:, :-1, :-1], 0.0).sum((1, 2))
    return np.sqrt(np.maximum(total, 1e-12))


def least_norms(kinds: np.ndarray) -> np.ndarray:
    """What norms gives for units of the same length without a repeated letter, which is the least."""
    by_size = np.array([sum((span - 2) * max(0, n - span + 1) * DECAY ** (2 * span) for span in range(3, n + 1)) for n in range(kinds.shape[1] + 1)])
    least = np.sqrt(np.maximum(by_size[(kinds != 255).sum(1)], 1e-12))
    return np.where((kinds == 0).any(1), 1e-6, least)


def gather(kinds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of the table's weights over the subsequences of each unit."""
    out = np.zeros(len(kinds))
    for rows, code, span in _triples(kinds):
        out[rows] += table[code] * DECAY ** span
    return out


@dataclass
class Units:
    """Distinct units of some texts, and where each text has them."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    unit: np.ndarray

    def strings(self) -> list[str]:
        return [bytes(self.data[a:b]).decode("utf-8", "ignore") for a, b in zip(self.start, self.end)]


def units(texts: pa.Array) -> Units:
    w = textscan.scan(texts, lower=True)
    start, end, data = w.start.copy(), w.end.copy(), w.data
    plain = _KIND[data] == 0
    while len(live := np.flatnonzero((start < end) & plain[np.minimum(start, len(data) - 1)])):
        start[live] += 1
    while len(live := np.flatnonzero((start < end) & plain[np.maximum(end - 1, 0)])):
        end[live] -= 1
    single = (end - start == 1)
    joined, spans, owners = [], [], []
    if single.any():
        edge = np.flatnonzero(np.diff(np.r_[False, single, False].astype(np.int8)))
        for a, b in zip(edge[::2], edge[1::2]):
            for t in np.unique(w.text[a:b]) if b - a > 2 else ():
                run = start[a:b][w.text[a:b] == t]
                if len(run) > 2:
                    joined.append(data[run])
                    owners.append(t)
    if joined:
        offset = len(data) + np.r_[0, np.cumsum([len(x) for x in joined])]
        data = np.concatenate([data, *joined])
        start, end = np.r_[start, offset[:-1]], np.r_[end, offset[1:]]
    owner = np.r_[w.text, np.array(owners, dtype=w.text.dtype)]
    keep = end - start >= 3
    start, end, owner = _windows(start[keep], end[keep], owner[keep])
    value = textscan._values(data, start, end) if len(start) and (np.diff(start) >= 0).all() and not joined else _each_value(data, start, end)
    _, first, unit = np.unique(value, return_index=True, return_inverse=True)
    return Units(data, start[first], end[first], owner, unit)


def _each_value(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    value = np.zeros(len(start), np.uint64)
    for k in range(int((end - start).max(initial=0))):
        rows = np.flatnonzero(start + k < end)
        value[rows] = textscan.mix(value[rows] + data[start[rows] + k].astype(np.uint64) + np.uint64(1 + 256 * k))
    return value


def vocabulary(docs: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(unit, toxic, clean): numbers of documents of either label that hold the unit."""
    docs = docs.select(text, label)

    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, 0):
                found, is_toxic = units(part.column(0)), np.asarray(part.column(1)) == 1
                if not len(found.start):
                    continue
                pairs = np.unique(found.text.astype(np.int64) * len(found.start) + found.unit)
                toxic = np.bincount(pairs % len(found.start), weights=is_toxic[pairs // len(found.start)], minlength=len(found.start))
                total = np.bincount(pairs % len(found.start), minlength=len(found.start))
                yield pa.RecordBatch.from_arrays([pa.array(found.strings()), pa.array(toxic.astype(np.int64)), pa.array((total - toxic).astype(np.int64))], ["unit", "toxic", "clean"])

    return docs.mapInArrow(run, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass
class Machine:
    """Weight of each subsequence and the bias; a positive decision is toxic."""

    table: np.ndarray
    bias: float
    offset: float = 0.0

    def decide(self, kinds: np.ndarray) -> np.ndarray:
        """Decisions of some units. A unit that even its least possible norm leaves in the clean half of the margin keeps that bound."""
        if not len(kinds):
            return np.zeros(0)
        total = gather(kinds, self.table)
        out = self.bias + np.maximum(total, 0.0) / least_norms(kinds)
        near = np.flatnonzero(out > self.bias / 2)
        out[near] = self.bias + total[near] / norms(kinds[near])
        return out

    def documents(self, texts: pa.Array) -> np.ndarray:
        """Decision of each text's worst unit."""
        out, found = np.full(len(texts), self.bias), units(texts)
        if len(found.start):
            order = np.argsort(found.end - found.start, kind="stable")
            worth = np.empty(len(order))
            for part in np.array_split(order, -(-len(order) // 4096)):
                worth[part] = self.decide(letters(found.data, found.start[part], found.end[part]))
            np.maximum.at(out, found.text, worth[found.unit])
        return out - self.offset

    def score(self, texts: pa.Array) -> np.ndarray:
        x = self.documents(texts)
        return 0.5 + 0.5 * x / (np.abs(x) + SOFT)


def _kinds_of(words: list[str]) -> np.ndarray:
    raw = [x.encode()[:LONGEST] for x in words]
    end = np.cumsum([len(x) for x in raw])
    return letters(np.frombuffer(b"".join(raw) or b" ", np.uint8), np.r_[0, end[:-1]].astype(np.int64), end)


def variants(words: list[str], seed: int = 7) -> list[str]:
    """Words with characters between their letters, a doubled letter, and one foreign letter inside."""
    rng, out = np.random.default_rng(seed), []
    for w in words:
        k = int(rng.integers(1, max(2, len(w) - 1)))
        out += ["-".join(w), w[:k] + w[k - 1] + w[k:], w[:k] + chr(int(rng.integers(0x61, 0x7B))) + w[k:], w[:k] + "*" + w[k:]]
    return out


def solve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Weights and bias of the linear machine with squared hinge, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag(np.r_[np.ones(x.shape[1] - 1), 1e-6])
    for _ in range(30):
        active = y * (x @ w) < 1
        a = x[active] * (penalty * weight[active])[:, None]
        new = np.linalg.solve(ridge + x[active].T @ a, a.T @ y[active])
        if np.abs(new - w).max() < 1e-8:
            return new
        w = new
    return w


def fit(words: DataFrame) -> Machine | None:
    """The machine of a stored vocabulary; None if it has no likely insult. Only bounded lists reach the driver."""
    sums = words.agg(F.max("toxic").alias("t"), F.max("clean").alias("c"), F.count("*").alias("n")).first()
    if not sums.t:
        return None
    # log-likelihood ratio of the unit's documents against the label's share of all documents
    share = sums.t / (sums.t + max(sums.c or 0, 1))
    n = F.col("toxic") + F.col("clean")
    evidence = 2 * (F.col("toxic") * F.log(F.col("toxic") / (n * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - share)))).otherwise(0.0))
    ratio = (F.col("toxic") / F.lit(float(sums.t))) / ((F.col("clean") + 0.5) / F.lit(float(max(sums.c or 0, 1))))
    likely = words.filter(F.col("toxic") >= MIN_DOCUMENTS).filter((ratio >= MIN_RATIO) & (evidence >= 2 * np.log(sums.n / BY_CHANCE))).withColumn("worth", F.col("toxic") * F.log(ratio))
    rows = likely.orderBy(F.desc("worth"), "unit").limit(POSITIVES).select("unit", "toxic").collect()
    insults, often = [r.unit for r in rows], np.sqrt([float(r.toxic) for r in rows])
    if not insults:
        return None
    innocent = words.filter("clean > 0").select("unit")
    clean = [r.unit for r in innocent.orderBy(F.xxhash64("unit"), "unit").limit(CLEAN).collect()]
    positive, marks = insults + variants(insults[:LANDMARKS]), insults[:LANDMARKS] + clean[:LANDMARKS]
    weight = np.r_[often, np.repeat(often[:LANDMARKS] / 8, 4)] / often.mean()
    for left in range(ROUNDS, -1, -1):
        space = Landmarks(marks)
        x = space.map(_kinds_of(positive + clean))
        y = np.r_[np.ones(len(positive)), -np.ones(len(clean))]
        solved = solve(x, y, np.r_[weight, np.full(len(clean), CLEAN_WEIGHT)])
        machine = Machine(space.table(solved[:-1]), float(solved[-1]))
        if left and clean:
            worst = [r.unit for r in _decided(innocent, machine).orderBy(F.desc("decision"), "unit").limit(CLEAN // 4).collect()]
            marks, clean = list(dict.fromkeys(marks + worst[:LANDMARKS])), list(dict.fromkeys(clean + worst))
    return machine


class Landmarks:
    """The space that the kernels with some units span."""

    def __init__(self, marks: list[str]):
        spectra = np.concatenate([spectrum(_kinds_of([m])) for m in marks])
        spectra /= np.maximum(np.sqrt(np.square(spectra).sum(1, keepdims=True)), 1e-6)
        self.codes = np.flatnonzero(spectra.any(0))
        self.own = np.zeros((len(self.codes) + 1, len(marks)), np.float32)
        self.own[1:] = spectra[:, self.codes].T
        self.place = np.zeros(KINDS ** 3, np.int32)
        self.place[self.codes] = np.arange(1, len(self.codes) + 1)
        value, vector = np.linalg.eigh((self.own.T @ self.own).astype(float))
        good = value > 1e-6 * value.max()
        self.root = vector[:, good] / np.sqrt(value[good])

    def map(self, kinds: np.ndarray) -> np.ndarray:
        """Coordinates of units: their kernels with the landmarks times the inverse root of the landmarks' own."""
        order = np.argsort((kinds != 255).sum(1), kind="stable")
        out = np.empty((len(kinds), self.root.shape[1]), np.float32)
        for part in np.array_split(order, max(1, len(order) // 2048)):
            own = kinds[part][:, :max(3, int((kinds[part] != 255).sum(1).max(initial=0)))]
            total = np.zeros((len(own), self.own.shape[1]), np.float32)
            for rows, code, span in _triples(own):
                total[rows] += self.own[self.place[code]] * np.float32(DECAY ** span)
            out[part] = (total / norms(own)[:, None]) @ self.root
        return out

    def table(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(KINDS ** 3, np.float32)
        out[self.codes] = self.own[1:] @ (self.root @ weights)
        return out


def _decided(words: DataFrame, machine: Machine) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(machine.decide(_kinds_of(part.column(0).to_pylist())))], ["unit", "decision"])

    return words.select("unit").mapInArrow(run, "unit string, decision double")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out=None, max_rows: int = MAX_ROWS) -> Machine | None:
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label IN (0, 1)")
    if held_out is not None:
        known = known.filter(~held_out)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    training = stored(docs.select("doc_id", "text").join(known, "doc_id").select("text", "label"), "toxic-training")
    machine = fit(stored(vocabulary(training), "units"))
    return machine and centred(training, machine)


def centred(training: DataFrame, machine: Machine) -> Machine:
    """The machine with its zero in the middle of the widest range of fewest training errors."""
    bins = score(training, machine, keep=("label",)).groupBy("label", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin")).count().collect()
    seen = np.zeros((2, BINS))
    for r in bins:
        seen[r.label, r.bin] = r["count"]
    wrong = np.r_[0, np.cumsum(seen[1])] + seen[0].sum() - np.r_[0, np.cumsum(seen[0])]
    best = np.flatnonzero(wrong == wrong.min())
    run = max(np.split(best, np.flatnonzero(np.diff(best) > 1) + 1), key=len)
    edge = np.clip((run[0] + run[-1]) / 2 / BINS, 0.5 / BINS, 1 - 0.5 / BINS)
    odds = 2 * edge - 1
    return replace(machine, offset=float(odds * SOFT / (1 - abs(odds))))


def score(docs: DataFrame, machine: Machine | None, text: str = "text", out: str = "score", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs with the score of each whole text."""
    if machine is None:
        return docs.select(*keep, F.lit(0.0).alias(out))
    docs = docs.select(*keep, text)

    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, len(keep)):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(machine.score(part.column(len(keep))))], [*keep, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:-1], T.StructField(out, T.DoubleType())]))


def score_all(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out=None) -> DataFrame:
    """doc_id and score of every document, learnt from the labelled rows that are not held out."""
    return score(docs, train(docs, labels, label, held_out))
