"""Vector search over a cell index that skips what the triangle inequality rules out."""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage

c = F.col

#: Bounds of the sample the centres are fitted on (rows that reach the driver) and of the number of cells.
SAMPLE, MAX_CELLS = 65_536, 4096
#: Questions and stored vectors that one task compares at a time.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 50_000
#: Rounding allowance of angles and scores; whatever it lets through is compared exactly.
SLACK = 1e-9


@dataclass
class Index:
    """rows (id, unit array<double>, cell int, angle double), one unit centre per cell, and per
    non-empty cell its number, largest angle to the centre and count of rows."""
    rows: DataFrame
    centres: np.ndarray
    cells: np.ndarray
    radius: np.ndarray
    counts: np.ndarray
    id_col: str


def unit_rows(column) -> np.ndarray:
    """Rows scaled to length one; rows of zeros stay."""
    m = np.stack(column.to_numpy()).astype(float)
    top = np.abs(m).max(axis=1, keepdims=True)
    m = m / np.where(top > 0, top, 1.0)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1.0)


def usable(rows: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Rows whose vector has dim entries, none of them null or non-finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == math.inf))
    return rows.where(c(column).isNotNull() & (F.size(column) == dim) & ~bad)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on the sample; starts are its first distinct rows."""
    _, first = np.unique(sample, axis=0, return_index=True)
    centres = sample[np.sort(first)[:cells]]
    for _ in range(rounds):
        near = nearest(sample, centres)[0]
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1.0), centres)
    return centres


def nearest(m: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre and the angle to it, in slices that keep the score matrix small."""
    cell, angle = np.empty(len(m), int), np.empty(len(m))
    for at in range(0, len(m), 2048):
        score = m[at:at + 2048] @ centres.T
        cell[at:at + 2048] = score.argmax(axis=1)
        angle[at:at + 2048] = np.arccos(np.clip(score.max(axis=1), -1.0, 1.0))
    return cell, angle


def build(vectors: DataFrame, dim: int, id_col: str = "vec_id", cells: int | None = None) -> Index:
    """Index of every usable row of vectors (id_col, embedding).

    Centres are fitted on the SAMPLE rows with the smallest hashes of their id, so refits agree; every
    row is then placed. The driver sees the sample and one line per cell. Rows that share an id are
    all indexed; rows with a null, short, long or non-finite vector are left out; zero vectors are
    placed like others and score 0. An empty table gives an index without cells."""
    spark = vectors.sparkSession
    vectors = usable(vectors.select(id_col, "embedding"), dim)
    sample = vectors.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).toPandas()
    if cells is None:
        total = len(sample) if len(sample) < SAMPLE else vectors.count()
        cells = min(MAX_CELLS, max(1, math.isqrt(total)))
    kind = dict(vectors.dtypes)[id_col]
    if not len(sample):
        empty = spark.createDataFrame([], f"{id_col} {kind}, unit array<double>, cell int, angle double")
        return Index(empty, np.zeros((0, dim)), *(np.zeros(0) for _ in range(3)), id_col)
    centres = fit_centres(unit_rows(sample["embedding"]), cells)
    shared = spark.sparkContext.broadcast(centres)

    def place(batches):
        for b in batches:
            if len(b):
                m = unit_rows(b["embedding"])
                cell, angle = nearest(m, shared.value)
                yield pd.DataFrame({id_col: b[id_col].to_numpy(), "unit": list(m), "cell": cell.astype("int32"), "angle": angle})

    rows = cut_lineage(vectors.mapInPandas(place, f"{id_col} {kind}, unit array<double>, cell int, angle double"))
    seen = rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("rows")).orderBy("cell").toPandas()
    return Index(rows, centres, seen["cell"].to_numpy(), seen["radius"].to_numpy(), seen["rows"].to_numpy(), id_col)


def bounds(index: Index, m: np.ndarray) -> np.ndarray:
    """Upper bound of the score of each question with any row of each non-empty cell.

    An angle to a row is at least the angle to the centre less the cell's radius. A zero question
    scores 0 everywhere, and a zero row may lie in any cell, so a bound is never below 0 where
    the radius reaches a right angle, which is the angle of a zero row."""
    to_centre = np.arccos(np.clip(m @ index.centres[index.cells].T, -1.0, 1.0))
    top = np.cos(np.clip(to_centre - index.radius - SLACK, 0.0, math.pi))
    top = np.where(index.radius + SLACK >= math.pi / 2, np.maximum(top, 0.0), top)
    return np.where((np.abs(m).max(axis=1) == 0)[:, None], 0.0, top)


def _visits(index: Index, asked: DataFrame, k: int, first: bool) -> DataFrame:
    """(query_id, unit, floor, cell): the cells of the first probe, or those that it leaves to visit.

    The probe takes cells by falling bound until they hold k rows. Afterwards a cell is left out when
    it was probed or its bound lies below the question's floor."""
    kind = dict(asked.dtypes)["query_id"]
    plain = Index(None, index.centres, index.cells, index.radius, index.counts, index.id_col)
    shared = asked.sparkSession.sparkContext.broadcast(plain)

    def choose(batches):
        held = shared.value
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at:at + 256]
                m = unit_rows(part["embedding"])
                bound = bounds(held, m)
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(held.counts[order], axis=1) - held.counts[order]
                probed = np.zeros(bound.shape, bool)
                np.put_along_axis(probed, order, before < k, axis=1)
                floor = part["floor"].to_numpy(float)
                reach = bound >= floor[:, None] - SLACK
                row, col = np.nonzero(reach & (probed if first else ~probed))
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "unit": pd.Series(list(m[row]), dtype=object),
                                    "floor": floor[row], "cell": held.cells[col].astype("int32")})

    return asked.mapInPandas(choose, f"query_id {kind}, unit array<double>, floor double, cell int")


def _meet(index: Index, visits: DataFrame, k: int) -> DataFrame:
    """The k best rows at or above its floor for each question and block of a visited cell.

    A cell's rows and questions are both dealt out by hash into blocks of bounded size, so neither a
    large cell nor one that every question visits is one task's work. Scores of what survives the
    screening are taken pair by pair, so equal vectors score alike in every block."""
    spark, id_col = visits.sparkSession, index.id_col
    kinds = dict(visits.dtypes)["query_id"], dict(index.rows.dtypes)[id_col]
    asked = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qn"))
    sizes = spark.createDataFrame([(int(x), -(-int(n) // VECTOR_BLOCK)) for x, n in zip(index.cells, index.counts)], "cell int, vn int")
    plan = F.broadcast(asked.join(F.broadcast(sizes), "cell"))      # at most MAX_CELLS rows

    def dealt(key, mine, other):
        return F.pmod(F.xxhash64(key), c(mine)).cast("int"), F.explode(F.sequence(F.lit(0), c(other) - 1))

    qb, vb = dealt("query_id", "qn", "vn")
    left = visits.join(plan, "cell").select("cell", "query_id", "unit", "floor", qb.alias("qb"), vb.alias("vb"))
    vb, qb = dealt(id_col, "vn", "qn")
    right = index.rows.join(plan, "cell").select("cell", id_col, "unit", vb.alias("vb"), qb.alias("qb"))

    def block(a, b):
        out = [pd.DataFrame({"query_id": a["query_id"].iloc[:0], id_col: b[id_col].iloc[:0], "score": np.zeros(0)})]
        if len(a) and len(b):
            b = b.sort_values(id_col)
            q, m, ids, names = np.stack(a["unit"].to_numpy()), np.stack(b["unit"].to_numpy()), b[id_col].to_numpy(), a["query_id"].to_numpy()
            low = a["floor"].to_numpy(float)
            for at in range(0, len(q), 64):
                score = q[at:at + 64] @ m.T
                floor = low[at:at + 64]
                if len(ids) > k:
                    floor = np.maximum(floor, np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k])
                row, col = np.nonzero(score >= floor[:, None] - SLACK)
                exact = np.einsum("ij,ij->i", q[at + row], m[col])
                order = np.lexsort((col, -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append(pd.DataFrame({"query_id": names[at + row[keep]], id_col: ids[col[keep]], "score": exact[keep]}))
        return pd.concat(out[1:] or out)

    keys = ["cell", "qb", "vb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, f"query_id {kinds[0]}, {id_col} {kinds[1]}, score double")


def _ranked(found: DataFrame, k: int, id_col: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(c("score").desc(), c(id_col))
    return found.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)


def _probe(index: Index, queries: DataFrame, k: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Usable questions, their ranked rows in the first probe, and the questions with raised floors."""
    asked = usable(queries.select("query_id", "embedding"), index.centres.shape[1]).withColumn("floor", F.lit(least))
    near = cut_lineage(_ranked(_meet(index, _visits(index, asked, k, True), k), k, index.id_col))
    kth = near.where(c("rank") == k).select("query_id", c("score").alias("kth"))
    return asked, near, asked.join(kth, "query_id", "left").withColumn("floor", F.greatest("floor", "kth")).drop("kth")


def search(index: Index, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """Exact cosine top-k of every question (query_id, embedding): query_id, id, score, rank from 1.

    A question first meets the cells of highest bound that hold k rows; its k-th score there (or the
    threshold) is the floor below which no other cell needs to be opened. query_id must be unique. Ties
    go to the smaller id. Questions with an unusable vector find nothing; a zero question scores 0
    with every row."""
    least = -math.inf if threshold is None else float(threshold)
    if not len(index.cells):
        kinds = dict(queries.dtypes)["query_id"], dict(index.rows.dtypes)[index.id_col]
        return queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, {index.id_col} {kinds[1]}, score double, rank int")
    _, near, raised = _probe(index, queries, k, least)
    found = near.drop("rank").unionByName(_meet(index, _visits(index, raised, k, False), k))
    return _ranked(found.where(c("score") >= least), k, index.id_col)


def opened(index: Index, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """Per question: cells that a search opens, the rows in them, and all cells of the index."""
    asked, _, raised = _probe(index, queries, k, -math.inf if threshold is None else float(threshold))
    visits = _visits(index, asked, k, True).unionByName(_visits(index, raised, k, False))
    sizes = asked.sparkSession.createDataFrame([(int(x), int(n)) for x, n in zip(index.cells, index.counts)], "cell int, rows long")
    seen = visits.join(F.broadcast(sizes), "cell").groupBy("query_id").agg(F.count(F.lit(1)).alias("opened"), F.sum("rows").alias("rows"))
    return seen.withColumn("cells", F.lit(len(index.cells)))
