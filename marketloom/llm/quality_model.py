"""Quality of documents by a regularised quadratic discriminant.

Every whole text becomes a vector of transformed statistics (logarithms of lengths and of smoothed
shares, so that short texts stay near the middle). For both labels the mean and covariance come
from counts, sums and products that each task adds up for itself; only these sums, of a fixed size,
reach the driver. Covariances are shrunk towards the pooled one and towards their diagonal, and
their Cholesky factors are inverted once. A score is the difference of the two log-densities, from
the Mahalanobis distances, pressed into 0 to 1 without saturation. As the statistics are not
Gaussian, the zero of that difference is set where the training rows are split with the fewest
errors, found from a histogram of `BINS` bins for each label.

All labelled rows of the training part are used. Null texts count as empty texts; null labels and
labels without a document are ignored; a label without any row makes the other label certain, and
without labels every score is 0.5. Repeated rows and null ids are rows of their own, an empty table gives an
empty one; extra columns pass through `keep_good`, whatever their names.
"""
from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan
from .common import split_by, stored

#: Shares of the pooled covariance and of the diagonal in a class covariance; score of half the range.
POOLED, DIAGONAL, RIDGE, SOFT = 0.1, 0.05, 1e-4, 6.0
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>", "bang": b"!?", "stop": b".,;:", "other": b"\"'()-/=@[]_{}~^`+\\", "line": b"\n"}
N_STATS = 8 + len(_KINDS)
BINS = 4000


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    w = textscan.scan(texts)
    n, words = w.n, np.bincount(w.text, minlength=w.n).astype(float)
    size = np.diff(w.edges).astype(float)
    owner = np.repeat(np.arange(n), np.diff(w.edges))

    def per_text(flags: np.ndarray, text: np.ndarray) -> np.ndarray:
        return np.bincount(text[flags], minlength=n).astype(float)

    def share(part, whole):
        return np.log((part + 0.5) / (whole + 10.0))

    def distinct(text, value):
        order = np.lexsort((value, text))
        t, v = text[order], value[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
        return np.bincount(t[new], minlength=n).astype(float)

    again = np.zeros(len(w.text), bool)
    again[1:] = (w.value[1:] == w.value[:-1]) & (w.text[1:] == w.text[:-1])
    three, at = textscan.grams(w, 3)
    threes = np.bincount(w.text[at], minlength=n).astype(float)
    letters = np.bincount(w.text, weights=w.end - w.start, minlength=n)
    out = [np.log1p(words), np.log((letters + 5.0) / (words + 1.0)),
           share(per_text(again, w.text), words), share(words - distinct(w.text, w.value), words),
           share(threes - distinct(w.text[at], three), threes),
           share(per_text(w.end - w.start <= 3, w.text), words), share(per_text(w.end - w.start >= 16, w.text), words),
           np.log((words + 10.0) / (per_text(w.data == 0x0A, owner) + 1.0))]
    for marks in _KINDS.values():
        kind = np.zeros(256, bool)
        kind[list(marks)] = True
        out.append(share(per_text(kind[w.data], owner), size))
    return np.column_stack(out)


def with_statistics(docs: DataFrame, text: str = "text", stats: str = "stats") -> DataFrame:
    """docs with the statistics in place of the text."""
    at = docs.columns.index(text)
    rest = [i for i, c in enumerate(docs.columns) if c not in (text, stats)]

    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, at):
                found = statistics(part.column(at))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * N_STATS), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), lists], [*(part.schema.names[i] for i in rest), stats])

    return docs.mapInArrow(run, T.StructType([*(docs.schema.fields[i] for i in rest), T.StructField(stats, T.ArrayType(T.DoubleType()))]))


@dataclass
class Discriminant:
    """Per label: count, mean, inverse Cholesky factor, half log-determinant."""

    counts: tuple[float, float]
    means: np.ndarray
    whiten: np.ndarray
    half_logdet: np.ndarray
    offset: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if not all(self.counts):
            return np.full(len(x), float(np.sign(self.counts[1] - self.counts[0])) * 1e6)
        density = [-0.5 * np.square((x - self.means[k]) @ self.whiten[k].T).sum(1) - self.half_logdet[k] for k in (0, 1)]
        return density[1] - density[0] - self.offset

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = self.log_odds(x)
        return 0.5 + 0.5 * odds / (np.abs(odds) + SOFT)


def fit(training: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """The discriminant of (stats, label) rows; labels are 0 and 1."""
    width = 1 + N_STATS + N_STATS * N_STATS

    def sums(batches):
        total = np.zeros((2, width))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, N_STATS)
            label = np.asarray(batch.column(1))
            for k in (0, 1):
                own = x[label == k]
                total[k] += np.r_[len(own), own.sum(0), (own.T @ own).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], width)), pa.array(np.tile(np.arange(width), 2)), pa.array(total.ravel())], ["label", "place", "total"])

    rows = training.select("stats", "label").filter("label IN (0, 1) AND stats IS NOT NULL").mapInArrow(sums, "label long, place long, total double").groupBy("label", "place").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((2, width))
    for r in rows:
        total[r.label, r.place] = r.total
    counts = total[:, 0]
    safe = np.maximum(counts, 1.0)[:, None]
    means = total[:, 1:1 + N_STATS] / safe
    scatter = total[:, 1 + N_STATS:].reshape(2, N_STATS, N_STATS) - safe[:, :, None] * means[:, :, None] * means[:, None, :]
    together = scatter.sum(0) / max(counts.sum(), 1.0)
    whiten, half = [], []
    for k in (0, 1):
        cov = (1 - pooled) * scatter[k] / safe[k] + pooled * together
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + RIDGE * np.eye(N_STATS)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        half.append(np.log(np.diag(factor)).sum())
    return Discriminant(tuple(counts), means, np.array(whiten), np.array(half))


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", held_out=None, **options) -> Discriminant:
    """Joins (doc_id, stats) to the label column and fits on the rows that are not held out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    if held_out is not None:
        known = known.filter(~held_out)
    return centred(rows := stats.join(known, "doc_id"), fit(rows, **options))


def centred(training: DataFrame, model: Discriminant) -> Discriminant:
    """The model with its zero in the middle of the widest range of fewest training errors."""
    if not all(model.counts):
        return model
    bins = score(training.filter("label IN (0, 1)").select("label", "stats"), model, "stats")
    found = bins.groupBy("label", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin")).count().collect()
    seen = np.zeros((2, BINS))
    for r in found:
        seen[r.label, r.bin] = r["count"]
    wrong = np.r_[0, np.cumsum(seen[1])] + seen[0].sum() - np.r_[0, np.cumsum(seen[0])]  # at each bin's lower edge
    best = np.flatnonzero(wrong == wrong.min())
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    run = max(runs, key=len)
    edge = np.clip((run[0] + run[-1]) / 2 / BINS, 0.5 / BINS, 1 - 0.5 / BINS)
    odds = 2 * edge - 1
    return replace(model, offset=float(odds * SOFT / (1 - abs(odds))))


def score(df: DataFrame, model: Discriminant, text: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """df with a score: from its text, or from its statistics if the text column is named stats."""
    at = df.columns.index(text)
    rest = [i for i, c in enumerate(df.columns) if c != out and (keep_text or c != text)]

    def run(batches):
        for batch in batches:
            for part in [batch] if text == "stats" else textscan.slices(batch, at):
                x = np.asarray(part.column(at).flatten()).reshape(-1, N_STATS) if text == "stats" else statistics(part.column(at))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), pa.array(model.score(x))], [*(part.schema.names[i] for i in rest), out])

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[i] for i in rest), T.StructField(out, T.DoubleType())]))


def score_all(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out=None) -> DataFrame:
    """doc_id and score of every document, learnt from the labelled rows that are not held out."""
    stats = stored(with_statistics(docs.select("doc_id", "text")), "statistics")
    return score(stats, train(stats, labels, label, held_out), "stats")


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """docs without those that score below the threshold, learnt from all labelled rows; no text is moved."""
    maybe, _ = split_by(docs.select("doc_id", "text"), labels.select("doc_id"), "doc_id")
    model = train(stored(with_statistics(maybe), "statistics"), labels, label)
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, keep_text=True, out=name).filter(F.col(name) >= threshold).select(*docs.columns)
