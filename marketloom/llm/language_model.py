"""Scores of whole documents under a gated recurrent language model.

Words (A-Z lower-cased) of all training documents are counted; every word has a count, none is dropped.
The network of `gru` predicts the `HEAD` commonest words one by one, in classes of `CLASS` words of
like frequency, and every other word by its outline (length, letters beyond ASCII, digits or symbols, a
mark at the end), which can be told without a look-up. Within an outline a word's share is its count
less an absolute discount; the discounts of all words of an outline are the share of its unseen words,
as one event. So every text has a proper log-probability over all words seen in training and one
unseen event per outline, and only sums over rare words need the table of counts.

Training: every document that learns takes part in one of `ROUNDS` rounds, with its whole text. In a
round tasks train on their own documents from the same start (parts of at most `CUT` tokens side by side
in lanes, truncated backpropagation over windows, state carried from window to window), and the
parameters are averaged by tokens, tree-wise. Biases start at the log frequencies of the whole
training corpus.

Scoring is one pass: the state is carried through the whole document, whatever its length. Counts of
the `WARM` commonest words (a few megabytes) travel to the tasks; rarer words of a document, which are
never hot, are joined with the table of counts and added up by document.

Null and empty texts are the end token alone. Rows are numbered, so repeated rows and null ids are
documents of their own; a null id is not held out. Without training documents every word is unseen. An
empty table gives an empty result. Only doc_id and text are read. Words and counts meet by 64-bit values.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru, textscan
from .common import release, stored

#: Words predicted one by one, words of a class, words whose counts travel to the tasks.
HEAD, CLASS, WARM = 4096, 64, 131_072
#: Hidden units, lanes and steps of a training window, tokens of a lane's part, rate of its steps, rounds, one of how many parts trains (1: all).
HIDDEN, LANES, STEPS, CUT, RATE, ROUNDS, SHARE = 32, 256, 16, 1024, 0.015, 3, 1
#: Bytes of text that a task scans at once, and that it scores at once: the more, the fewer steps have few lanes.
SLICE, SCORED = 4 << 20, 8 << 20
OUTLINES = 24
PARTIAL = ("rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
           "rare_value array<long>, rare_code array<int>")

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def outlines(w: textscan.Words) -> np.ndarray:
    """Outline of every word: 4 lengths, 3 kinds of characters, with or without a mark at the end."""
    def held(flags):
        sums = np.zeros(len(w.data) + 1, np.int32)
        np.cumsum(flags, out=sums[1:])
        return sums[w.end] - sums[w.start]

    if not len(w.start):
        return np.empty(0, np.int32)
    beyond = w.data >= 0x80
    last = w.data[w.end - 1]
    mark = ~(_LETTER[last] | _DIGIT[last] | (last >= 0x80))
    other = held(~(_LETTER[w.data] | beyond)) - mark
    kind = np.where(held(beyond) > 0, 1, np.where(other > 0, 2, 0))
    length = np.searchsorted([4, 7, 10], w.end - w.start, "right")
    return (length * 6 + kind * 2 + mark).astype(np.int32)


def word_counts(docs: DataFrame) -> DataFrame:
    """(value, outline, n) of all words of all texts; runs of text are counted before they leave a task."""
    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, 0, SLICE):
                w = textscan.scan(part.column(0), lower=True)
                value, at, n = np.unique(w.value, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(outlines(w)[at]), pa.array(n.astype(np.int64))], ["value", "outline", "n"])

    return docs.select("text").mapInArrow(run, "value long, outline int, n long").groupBy("value").agg(F.max("outline").alias("outline"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What scoring needs of the counts: totals, the commonest words, sums of each outline."""

    total: int
    distinct: int
    ends: int
    n_head: int
    value: np.ndarray  # the WARM commonest words, sorted by value
    outline: np.ndarray
    count: np.ndarray
    rank: np.ndarray  # place by frequency
    sums: np.ndarray  # words, distinct, once, twice of every outline without the single words

    def shape(self) -> gru.Shape:
        return gru.Shape(self.n_head + 1, CLASS, OUTLINES, HIDDEN)

    def frequencies(self) -> np.ndarray:
        """Counts of the network's tokens: the end, single words by rank, outlines."""
        by_rank = self.count[np.argsort(self.rank)][:self.n_head]
        return np.r_[self.ends, by_rank, self.sums[:, 0]].astype(np.float64)

    def find(self, w: textscan.Words, outline: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token and place in the table (-1: none) of every word."""
        place = np.minimum(np.searchsorted(self.value, w.value), max(0, len(self.value) - 1))
        place = np.where(self.value[place] == w.value, place, -1) if len(self.value) else np.full(len(w.value), -1)
        rank = np.where(place >= 0, self.rank[place], self.n_head) if len(self.value) else np.zeros(len(w.value), np.int64)
        return np.where(rank < self.n_head, rank + 1, self.n_head + 1 + outline), place

    def discounts(self) -> tuple[np.ndarray, np.ndarray]:
        """Discount of every outline's counts, and the probability of its unseen words."""
        words, distinct, once, twice = self.sums.T.astype(np.float64)
        discount = (once + 0.5) / (once + 2 * twice + 1)
        return discount, np.where(words > 0, discount * distinct / np.maximum(words, 1), 1.0)

    def base(self, count):
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """From the whole table of counts; ends: number of training documents."""
    top = counts.orderBy(F.desc("n"), "value").limit(WARM).toArrow()
    value, outline, count = (np.array(top.column(c)) for c in ("value", "outline", "n"))
    n_head = min(HEAD - 1, len(value))
    sums = np.zeros((OUTLINES, 4), np.int64)
    one = counts.groupBy("outline").agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2))
    for r in one.collect():
        sums[r[0]] = r[1:]
    total, distinct = int(sums[:, 0].sum()) + ends, int(sums[:, 1].sum()) + (ends > 0)
    for o, c in zip(outline[:n_head], count[:n_head]):
        sums[o] -= np.array([c, 1, c == 1, c == 2])
    order = np.argsort(value.view(np.uint64))
    return Vocabulary(total, distinct, ends, n_head, value.view(np.uint64)[order], outline[order], count[order], order.astype(np.int64), sums)


def sequences(w: textscan.Words, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, each with its end (token 0), and where the texts begin."""
    first = w.first() + np.arange(w.n + 1)
    ids = np.zeros(len(tokens) + w.n, np.int64)
    ids[np.arange(len(tokens)) + w.text] = tokens
    return ids, first


def train(docs: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Parameters after all rounds; together they pass over all docs (doc_id, text)."""
    sc, shape = docs.sparkSession.sparkContext, vocab.shape()
    flat = gru.initial(shape, vocab.frequencies())
    words = sc.broadcast(vocab)
    for turn in range(ROUNDS):
        start = sc.broadcast(flat)

        def run(batches):
            trainer = gru.Trainer(shape, start.value, RATE)
            for batch in batches:
                for part in textscan.slices(batch, 0, SLICE):
                    w = textscan.scan(part.column(0), lower=True)
                    ids, first = sequences(w, words.value.find(w, outlines(w))[0])
                    trainer.learn(gru.Lanes(ids, first, LANES, 0, CUT), STEPS)
            if trainer.tokens:
                yield pa.RecordBatch.from_arrays([pa.array([trainer.net.flat.tobytes()], pa.binary()), pa.array([trainer.tokens], pa.int64())], ["flat", "tokens"])

        mine = F.pmod(F.xxhash64("doc_id"), F.lit(SHARE * ROUNDS)) == turn
        learnt = docs.filter(mine).select("text").mapInArrow(run, "flat binary, tokens long").rdd
        total, tokens = learnt.treeAggregate(
            (0.0, 0), lambda a, r: (a[0] + np.frombuffer(r.flat, np.float32).astype(np.float64) * r.tokens, a[1] + r.tokens),
            lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=3)
        if tokens:
            flat = (total / tokens).astype(np.float32)
    return flat


def partial_scores(docs: DataFrame, vocab: Vocabulary, flat: np.ndarray) -> DataFrame:
    """Every document's sums over all but its rare words, and those words with their numbers of uses."""
    sc, shape = docs.sparkSession.sparkContext, vocab.shape()
    words, weights = sc.broadcast(vocab), sc.broadcast(flat)

    def run(batches):
        v, net = words.value, gru.Network(shape, weights.value)
        table, (discount, _) = net.table(), v.discounts()
        for batch in batches:
            for part in textscan.slices(batch, 3, SCORED):
                n = part.num_rows
                w = textscan.scan(part.column(3), lower=True)
                outline = outlines(w)
                tokens, place = v.find(w, outline)
                score = gru.log_likelihood(net, table, *sequences(w, tokens), 0) / np.log(10)
                known = place >= 0
                count = v.count[place[known]]
                base = np.bincount(w.text[known], v.base(count), n) + v.base(v.ends)
                inner = tokens[known] > v.n_head
                share = (count[inner] - discount[outline[known][inner]]) / v.sums[outline[known][inner], 0]
                score += np.bincount(w.text[known][inner], np.log10(share), n)
                text, value, kind = w.text[~known], w.value[~known], outline[~known]
                order = np.lexsort((value, text))
                text, value, kind = text[order], value[order], kind[order]
                new = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])][:len(text)])
                uses = np.diff(np.r_[new, len(text)])
                edges = pa.array(np.searchsorted(text[new], np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(2), pa.array(np.diff(w.first()) + 1),
                    pa.array(np.bincount(w.text[known], minlength=n) + int(v.ends > 0)), pa.array(base), pa.array(score),
                    pa.ListArray.from_arrays(edges, pa.array(value[new].view(np.int64))),
                    pa.ListArray.from_arrays(edges, pa.array((uses * 32 + kind[new]).astype(np.int32)))],
                    ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare_value", "rare_code"])

    return docs.select("rid", "doc_id", "held_out", "text").mapInArrow(run, PARTIAL)


def rare_scores(partial: DataFrame, counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(rid, known, base, inner): sums over the rare words of each document."""
    discount, unseen = vocab.discounts()
    numbers = lambda x: F.array(*[F.lit(float(e)) for e in x])
    uses, kind, seen = F.shiftright("code", 5), F.col("code").bitwiseAND(F.lit(31)), F.col("n").isNotNull()
    rows = partial.select("rid", F.explode(F.arrays_zip("rare_value", "rare_code")).alias("r")).select("rid", F.col("r.rare_value").alias("value"), F.col("r.rare_code").alias("code"))
    share = F.when(seen, (F.col("n") - F.get(numbers(discount), kind)) / F.get(numbers(vocab.sums[:, 0]), kind)).otherwise(F.get(numbers(unseen), kind))
    size = float(vocab.total + 0.1 * (vocab.distinct + 1))
    return rows.join(counts.select("value", "n"), "value", "left").groupBy("rid").agg(
        F.sum(F.when(seen, uses).otherwise(0)).alias("known"),
        F.sum(uses * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(size))).alias("base"),
        F.sum(uses * F.log10(share)).alias("inner"))


def score_all(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document; held_out ones teach nothing."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    learn = docs.filter(~F.coalesce(held_out, F.lit(False))).select("doc_id", "text")
    counts = stored(word_counts(learn), "word-counts")
    vocab = vocabulary(counts, learn.count())
    flat = train(learn, vocab)
    partial = stored(partial_scores(rows, vocab, flat), "partial-scores")
    release(spark)
    rare = rare_scores(partial, counts, vocab)
    zero = F.lit(0)
    return partial.join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", zero)).alias("base_score"), (F.col("score") + F.coalesce("inner", zero)).alias("score"))
