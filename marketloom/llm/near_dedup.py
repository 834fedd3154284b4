"""Near-duplicate documents by HyperMinHash sketches, banding and exact confirmation.

A document is the set of its distinct k-word sequences (A-Z lower-cased; a text with fewer words is
one sequence). The 64-bit value of a sequence picks one of 128 buckets by its first bits; a bucket
keeps of its least value only the number of leading zeros and ten bits after the leading one, two
bytes in all. Documents with equal sets collapse first, so copies cost one sketch. Equal runs of
registers (bands) propose pairs; the Jaccard estimate of two sketches, corrected for registers that
agree by chance, drops unlikely pairs early; the rest are confirmed on their full sets. At the
threshold itself a pair shares no band with a chance below one in a million.

Bands with at most `COLD` sets give all their pairs. A larger band links each set to at most three
representatives of its bands. While its sets still lie in several components, those outside the
largest one meet other members of it in rounds, which halves them in a family of like texts; when
few are left, or rounds find nothing, the rest is closed by a prefix filter: sequences are ordered by
how many open sets hold them, two sets at the threshold share one of their rarest ones at a place that
leaves enough sequences after it, and only such pairs are compared, so none is missed and like texts
below the threshold, which share only their common sequences, do not meet. Lists in one task never
exceed `COLD` entries or the number of bands.

Null and empty texts have no sequences and link with nothing. Repeated rows are copies of each
other; a null doc_id can be linked and never names a component while another member has an id. Very long
texts are scanned in runs of a few megabytes. An empty table gives an empty result. Only doc_id and text
are read; columns with any other name pass through `drop_copies` untouched.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textscan
from .common import discard, release, split_by, stored
from .components import components

BUCKETS, MANTISSA, EMPTY = 128, 10, 0xFFFF
COLD, REPRESENTATIVES, LINEAR = 32, 3, 4
#: Room below the threshold for the estimate, five standard deviations of 128 registers.
ROOM = 0.2
#: Words of 64 bits that mark a set's shared sequences where open sets are compared.
BITS = [f"bits{i}" for i in range(8)]
SKETCH = "doc_id long, n long, s1 long, s2 long, bands array<long>, registers binary"


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, value) of all distinct k-word sequences, sorted by text and value."""
    w = textscan.scan(texts, lower=True)
    value, at = textscan.grams(w, k)
    text = w.text[at].astype(np.int64)
    first = w.first()
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            more = counts[short] > i
            whole[more] = textscan.mix(whole[more] * np.uint64(0xD6E8FEB86659FD93) + w.value[first[short][more] + i] + np.uint64(101 + i))
        value, text = np.r_[value, whole], np.r_[text, short]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return text[new], value[new]


def bit_length(x: np.ndarray) -> np.ndarray:
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])


def registers(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Compressed registers of n texts from their sorted sequence values."""
    bucket = (value >> np.uint64(57)).astype(np.int64)
    place = text * BUCKETS + bucket
    least = np.ones(len(place), bool)
    least[1:] = place[1:] != place[:-1]
    rest = value[least] << np.uint64(7)
    zeros = 64 - bit_length(rest)
    after = np.where(zeros < 63, rest << np.minimum(zeros + 1, 63).astype(np.uint64), np.uint64(0)) >> np.uint64(64 - MANTISSA)
    out = np.full(n * BUCKETS, EMPTY, np.uint16)
    out[place[least]] = (np.minimum(zeros, 57).astype(np.uint16) << MANTISSA) | after.astype(np.uint16)
    return out.reshape(n, BUCKETS)


def band_keys(regs: np.ndarray, rows: int) -> list[np.ndarray]:
    """Values of the bands of each text that are not empty."""
    n_bands = BUCKETS // rows
    used = regs[:, :n_bands * rows].reshape(len(regs), n_bands, rows).astype(np.uint64)
    key = np.tile(np.arange(1, n_bands + 1, dtype=np.uint64), (len(regs), 1))
    for i in range(rows):
        key = textscan.mix(key * np.uint64(0xD6E8FEB86659FD93) + used[:, :, i] + np.uint64(1))
    filled = (used != EMPTY).any(2)
    return [k[f].view(np.int64) for k, f in zip(key, filled)]


def digests(text: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sizes and the two halves of a digest of each set."""
    count = np.bincount(text, minlength=n)
    starts = np.searchsorted(text, np.arange(n))
    halves = []
    for salt in (0x1234567, 0x89ABCDE):
        sums = np.r_[np.uint64(0), np.cumsum(textscan.mix(value + np.uint64(salt)))]
        halves.append((sums[starts + count] - sums[starts]).view(np.int64))
    return count, halves


def sketches(docs: DataFrame, k: int, rows: int) -> DataFrame:
    """One row per document: size and 128-bit digest of its set, bands, registers."""
    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, 1):
                n = part.num_rows
                text, value = shingle_sets(part.column(1), k)
                count, digest = digests(text, value, n)
                regs = registers(text, value, n)
                keys = band_keys(regs, rows)
                edges = np.zeros(n + 1, np.int32)
                np.cumsum([len(x) for x in keys], out=edges[1:])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(count.astype(np.int64)), pa.array(digest[0]), pa.array(digest[1]),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))),
                    pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "n", "s1", "s2", "bands", "registers"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, without the agreements that chance explains."""
    filled = (a != EMPTY) | (b != EMPTY)
    both = (a != EMPTY) & (b != EMPTY)
    used = np.maximum(filled.sum(1), 1)
    chance = both.sum(1) * 2.0 ** -MANTISSA / 3  # a third: two minima seldom have the same number of zeros
    return np.maximum((both & (a == b)).sum(1) - chance, 0.0) / (used - np.minimum(chance, used - 1))


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets whose sizes and sketches allow the threshold."""
    side = sets.select("cid", "n", "registers")
    a = side.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("reg_a"))
    b = side.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("reg_b"))
    sized = pairs.join(a, "a").join(b, "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def run(batches):
        for batch in batches:
            regs = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BUCKETS) for i in (2, 3)]
            good = pa.array(estimate(*regs) >= percent / 100 - ROOM)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    return sized.select("a", "b", "reg_a", "reg_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    a = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))

    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, 2):
                n = part.num_rows
                ta, va = shingle_sets(part.column(2), k)
                tb, vb = shingle_sets(part.column(3), k)
                text, value = np.r_[ta, tb], np.r_[va, vb]
                order = np.lexsort((value, text))
                text, value = text[order], value[order]
                shared = np.bincount(text[1:][(text[1:] == text[:-1]) & (value[1:] == value[:-1])], minlength=n)
                union = np.bincount(text, minlength=n) - shared
                good = pa.array((100 * shared >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], ["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def find_groups(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, uid (unique), n_shingles, component_id and kept (one row of each group) for every row."""
    rows = 5 if percent >= 85 else 4
    sketched = stored(sketches(docs, k, rows).withColumn("uid", F.monotonically_increasing_id()), "sketches")
    full = sketched.filter("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("least_id"), F.col("uid").alias("keep_uid")))
    classes = stored(full.groupBy("n", "s1", "s2").agg(F.min("uid").alias("cid"), first.alias("first")), "sets")
    sets = full.join(classes.select(F.col("cid").alias("uid")), "uid", "left_semi").withColumnRenamed("uid", "cid")
    label = _labels(docs, stored(sets, "distinct-sets"), k, percent).withColumnRenamed("node", "cid")
    named = stored(classes.join(label, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "named")
    best = stored(named.groupBy("component").agg(F.min("first").alias("best")), "best")
    final = stored(named.join(best, "component").select("n", "s1", "s2", F.col("best.least_id").alias("component_id"), F.col("best.keep_uid").alias("keep_uid")), "components")
    alone = F.col("n") == 0
    return sketched.join(final, ["n", "s1", "s2"], "left").select(
        "uid", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"))


def _labels(docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of the distinct sets that reach the threshold with another one."""
    bands = sets.select("cid", "n", F.explode("bands").alias("key"))
    groups = stored(bands.groupBy("key").agg(F.count("*").alias("size"), F.min("cid").alias("rep")).filter("size > 1"), "bands")
    cold = bands.join(groups.filter(F.col("size") <= COLD).select("key"), "key")
    listed = cold.groupBy("key").agg(F.sort_array(F.collect_list("cid")).alias("c"))
    partners = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice(F.col("c"), i + 2, F.lit(COLD)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = listed.select(F.inline(partners)).distinct()
    hot = stored(bands.join(groups.filter(F.col("size") > COLD).select("key", "rep"), "key"), "hot-bands")
    any_hot = not hot.isEmpty()
    if any_hot:
        reps = hot.filter("cid != rep").groupBy("cid").agg(F.slice(F.sort_array(F.collect_set("rep")), 1, REPRESENTATIVES).alias("reps"))
        pairs = pairs.union(reps.select(F.explode("reps").alias("a"), F.col("cid").alias("b"))).distinct()
    likely = stored(_likely(pairs, sets, percent), "likely")
    wanted = likely.select("a").union(likely.select("b"))
    texts = _texts(docs, sets, (wanted.union(hot.select("cid")) if any_hot else wanted).distinct(), k)
    label = components(_confirmed(likely, texts, k, percent))
    discard(likely)
    release(docs.sparkSession)
    return _closed(hot, label, sets, texts, k, percent) if any_hot else label


def _closed(hot: DataFrame, label: DataFrame, sets: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """label after all pairs inside hot bands that could still join two components have been decided.

    Sets outside the largest component of a band meet other members of it, a few in each round,
    as long as that finds links and all their pairs would be more than `LINEAR` for each row."""
    before, turn = None, 0
    rows = hot.count()
    while True:
        edges = label.select(F.col("node").alias("a"), F.col("component").alias("b"))
        left = stored(hot.drop("rep").join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")), "hot-labels")
        parts = left.groupBy("key", "component").agg(F.count("*").alias("members"))
        main = stored(parts.groupBy("key").agg(F.max_by("component", F.struct("members", "component")).alias("main"), F.max("members").alias("inside"), F.sum("members").alias("members"))
                      .filter("inside < members"), "main-components")
        open_ = main.agg(F.sum(F.col("members") - F.col("inside")).alias("outer"), F.sum((F.col("members") - F.col("inside")) * F.col("members")).alias("pairs")).first()
        if not open_.outer:
            return label
        bands = left.join(main.select("key", "main"), "key")
        if open_.pairs <= LINEAR * rows or (before is not None and open_.outer > 0.9 * before):
            break
        before, turn = open_.outer, turn + 1
        reps = bands.filter("component = main").groupBy("key").agg(F.min_by("cid", F.xxhash64("cid", F.lit(turn))).alias("rep"))
        some = bands.filter("component != main").join(reps, "key").groupBy("cid").agg(F.slice(F.sort_array(F.collect_set("rep")), 1, REPRESENTATIVES).alias("reps"))
        pairs = some.select(F.explode("reps").alias("x"), F.col("cid").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        likely = stored(_likely(pairs, sets, percent), "round-likely")
        old, label = label, components(edges.union(_confirmed(likely, texts, k, percent)))
        discard(old, left, main, likely)
        release(label.sparkSession)
    members = stored(bands.groupBy("cid").agg(F.max("n").alias("n"), F.max("component").alias("component"), F.max(F.col("component") != F.col("main")).alias("outer")), "open-members")
    discard(left, main)
    likely = stored(_likely(_prefix_pairs(members, texts, k, percent), sets, percent), "more-likely")
    return components(edges.union(_confirmed(likely, texts, k, percent)))


def _values(texts: DataFrame, k: int) -> DataFrame:
    """(cid, value) of all sequences of sets."""
    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, 1):
                text, value = shingle_sets(part.column(1), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(part.column(0))[text]), pa.array(value.view(np.int64))], ["cid", "value"])

    return texts.select("cid", "text").mapInArrow(run, "cid long, value long")


def _prefix_pairs(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of an outer member and a member of another component that could reach the threshold.

    members: cid, n, component and outer. A set that reaches the threshold with another one shares all
    but a few of its sequences, so one with more sequences of its own has no partner. Of the shared
    sequences of the others, rarest first, the first common one of a pair lies so early on both sides
    that enough of them follow. Places marked in one set's bitmap and not in the other's are sequences they
    do not share, so like texts below the threshold mostly do not become pairs; no pair at it is lost."""
    single = _values(texts.join(members.select("cid"), "cid", "left_semi"), k).groupBy("value").agg(F.count("*").alias("uses"), F.min("cid").alias("cid")).filter("uses = 1")
    lonely = single.groupBy("cid").agg(F.count("*").alias("lonely"))
    able = stored(members.join(lonely, "cid", "left").filter((F.col("n") - F.coalesce("lonely", F.lit(0))) * 100 >= F.col("n") * percent).drop("lonely"), "able-sets")
    values = stored(_values(texts.join(able.select("cid"), "cid", "left_semi"), k), "able-values")
    shared = values.join(values.groupBy("value").agg(F.count("*").alias("uses")).filter("uses > 1"), "value")
    able = able.join(shared.groupBy("cid").agg(F.count("*").alias("in_common"), *_bitmap(F.col("value"))), "cid")
    shared = shared.join(able, "cid")
    own = Window.partitionBy("cid")
    ranked = shared.withColumn("place", F.row_number().over(own.orderBy("uses", "value"))).withColumn("after", F.count("*").over(own) - F.col("place") + 1)
    prefix = stored(ranked.filter(F.col("after") * 100 >= F.col("n") * percent).select("value", "cid", "n", "component", "outer", "after", "in_common", *BITS), "prefixes")
    discard(values)
    x = prefix.filter("outer").select(*[F.col(c).alias(f"{c}_x") for c in prefix.columns if c not in ("value", "outer")], "value")
    most = F.least("after_x", "after", F.col("in_common_x") - _beyond("_x", ""), F.col("in_common") - _beyond("", "_x"))
    both = x.join(prefix, "value").filter("component_x != component").filter(most * (100 + percent) >= (F.col("n_x") + F.col("n")) * percent)
    return both.select(F.least("cid_x", "cid").alias("a"), F.greatest("cid_x", "cid").alias("b")).distinct()


def _bitmap(value: Column) -> list[Column]:
    """Aggregates that mark the places of values among 64 bits of each of `BITS`."""
    place = F.xxhash64(value)
    word, bit = F.pmod(F.shiftright(place, 6), F.lit(len(BITS))), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    return [F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(name) for i, name in enumerate(BITS)]


def _beyond(one: str, other: str) -> Column:
    """Bits of one side that the other lacks: at least so many values are not shared."""
    return sum((F.bit_count(F.col(b + one).bitwiseAND(F.bitwise_not(F.col(b + other)))) for b in BITS), F.lit(0))


def _texts(docs: DataFrame, sets: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cid, text) of the wanted sets, one row each."""
    who = sets.join(wanted.withColumnRenamed("a", "cid"), "cid", "left_semi").select("cid", "doc_id", "n", "s1", "s2")
    who = stored(who, "wanted")
    every = docs.select(F.col("doc_id").cast("long").alias("d_id"), "text")
    source, _ = split_by(every, who.select(F.col("doc_id").alias("d_id")), "d_id")  # no other text is moved
    who = who.hint("merge")
    found = source.join(who, source["d_id"].eqNullSafe(who["doc_id"])).select("cid", "text")
    if _ids_repeat(docs):  # another text may have the same doc_id
        found = _own(source.join(who, source["d_id"].eqNullSafe(who["doc_id"])).select("cid", "text", "n", "s1", "s2"), k).dropDuplicates(["cid"])
    return stored(found, "texts")


def _ids_repeat(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def _own(found: DataFrame, k: int) -> DataFrame:
    """Rows whose text has the set with the given digest."""
    def run(batches):
        for batch in batches:
            for part in textscan.slices(batch, 1):
                count, (s1, s2) = digests(*shingle_sets(part.column(1), k), part.num_rows)
                good = pa.array((count == np.asarray(part.column(2))) & (s1 == np.asarray(part.column(3))) & (s2 == np.asarray(part.column(4))))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], ["cid", "text"])

    return found.mapInArrow(run, "cid long, text string")


def drop_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group. Rows that share a doc_id stay if one of them does; equal ones among them become one.

    Only rows that may have a dropped identifier are moved."""
    found = find_groups(docs, k, percent)
    gone = stored(found.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept").select(F.col("doc_id").alias("gone")), "dropped")
    rows = docs.select(F.col("doc_id").cast("long").alias("gone"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    maybe, kept = split_by(rows, gone, "gone")
    lost = gone.select(F.col("gone").alias("lost")).hint("merge")
    out = kept.unionByName(maybe.join(lost, F.col("gone").eqNullSafe(F.col("lost")), "left_anti")).select("row.*")
    return out.dropDuplicates(["doc_id", "text"]) if _ids_repeat(docs) else out
