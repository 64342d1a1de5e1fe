"""Exact top-k inner products by multi-resolution segment statistics.

For a vector cut into segments of length ``l``, a segment's mean ``m`` and deviation ``s`` bound
the product with a query from above: ``sum over segments of l * (mq * mx + sq * sx)``, by
Cauchy and Schwarz; with both squared norms that is a lower bound on the distance.  Bounds
are evaluated from coarse (one segment) to fine (segments of two components); a candidate whose
bound is below the query's k-th best score so far is dropped, a finer level looks at what the
coarser ones left, and only survivors get exact scores.  The bounds have a margin for rounding,
so nothing is lost.  A level is a matrix product over a block while more than ``GATHERED`` of its
pairs are alive (that is faster than picking them out), and a product a query beyond.

Queries meet candidates by cells (:mod:`tallyrill.llm.grid`): a part of either in a task, in one job, without the driver; a cell keeps k + 1 rows a
query, and the cells' lists are merged by a grouped top-k.  A level is left out of the rest of a cell once it has been seen to drop a smaller share
of its pairs than it costs of a product.  Queries equal in id and vector are searched once, and so are equal candidates.

Components become ``floor(scale * x)`` with x as a double.  While products stay below 2**53
the arithmetic is exact in doubles; beyond, exact Python integers are used, and a score
outside the range of a long counts as the nearest long.

Defined cases: a row takes no part if its id or vector is null, its vector is empty or holds a null or non-finite
component (or one whose scaled value is beyond a double); vectors of different lengths have no score with each other; a query never
meets its own row, but does meet another row with its id; ties go to the smaller id; a
query with fewer candidates than k returns them all, one without any returns no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrill.llm import grid
from tallyrill.llm.shared import discard, written

#: Segments by level, from coarse to fine; a level of as many segments as components is the product itself.
LEVELS = (1, 4, 16, 32)
#: Queries that a cell searches at a time, and pairs after which a level's yield counts.
QUERIES, PROBED = 1024, 1 << 22
#: Share of pairs alive up to which a finer level picks them out.
GATHERED = 0.1
SAFE = float(1 << 53)
#: No floor is above: scores from there on may be equal once they count as longs.
HIGHEST = (1 - 1e-9) * 2.0**63


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Segment means and deviations side by side, so that a product of two rows is the bound."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    root = np.sqrt([len(p) for p in parts])
    mean = np.stack([x[:, p].mean(1) for p in parts], 1)
    dev = np.stack([x[:, p].std(1) for p in parts], 1)
    return np.concatenate([mean * root, dev * root], 1)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, as doubles where exact, else as Python integers."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[-1] < SAFE:
        return q @ x.T
    whole = lambda a: np.array([[int(c) for c in r] for r in a], object)
    return whole(q).dot(whole(x).T)


class Searcher:
    """The running top ``keep`` of one cell for queries of one dimension."""

    def __init__(self, queries: np.ndarray, floor: np.ndarray, keep: int) -> None:
        self.q, self.keep, self.floor = queries, keep, floor
        self.stats = [(s, _statistics(queries, s)) for s in LEVELS if s < queries.shape[1]]
        self.size = np.linalg.norm(queries, axis=1)
        self.best: list[list[tuple]] = [[] for _ in queries]  # (-score, id, row), ascending
        self.seen = {s: [0, 0] for s, _ in self.stats}  # pairs that a level has met, and dropped
        self.pairs = self.products = 0  # met, and scored exactly

    def _pays(self, level: int) -> bool:
        met, dropped = self.seen[level]
        return met < PROBED or dropped * self.q.shape[1] >= 2 * level * met

    def survivors(self, x: np.ndarray) -> np.ndarray:
        """Which candidates no bound rules out, a row for each query."""
        alive = np.ones((len(self.q), len(x)), bool)
        norm = np.linalg.norm(x, axis=1)
        for s, own in self.stats:
            if not self._pays(s) or not np.isfinite(self.floor).any():
                continue
            theirs, before = _statistics(x, s), np.count_nonzero(alive)
            if before > GATHERED * alive.size:
                alive &= own @ theirs.T + 1e-9 * self.size[:, None] * norm + 1e-6 >= self.floor[:, None]
            else:
                for i in np.flatnonzero(alive.any(1)):
                    at = np.flatnonzero(alive[i])
                    alive[i, at] = theirs[at] @ own[i] + 1e-9 * self.size[i] * norm[at] + 1e-6 >= self.floor[i]
            self.seen[s][0] += before
            self.seen[s][1] += before - np.count_nonzero(alive)
        return alive

    def add(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Candidates with their ids and, if given, the numbers of their rows."""
        if not len(self.q):
            return
        alive = self.survivors(x)
        self.pairs += alive.size
        for i in np.flatnonzero(alive.any(1)):
            at = np.flatnonzero(alive[i])
            self.products += len(at)
            scores = _exact(self.q[i][None], x[at])[0]
            near = np.flatnonzero((scores >= self.floor[i]).astype(bool))
            if len(near) > 4 * self.keep and scores.dtype != object:
                cut = np.partition(scores[near], len(near) - self.keep)[len(near) - self.keep]
                near = near[scores[near] >= cut]
            if len(near):
                found = [(-_clip(int(scores[j])), int(ids[at[j]]), int(at[j] if rows is None else rows[at[j]])) for j in near]
                self.best[i] = sorted(self.best[i] + found)[: self.keep]
                if len(self.best[i]) == self.keep:
                    self.floor[i] = min(HIGHEST, max(self.floor[i], float(-self.best[i][-1][0])))


def _clip(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, score))


def _cell(keep: int):
    """The best of one cell for each query, without the query's own row."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: list[tuple] = []
        ids, times, theirs = candidates["vec_id"].to_numpy(), candidates["times"].to_numpy(), grid.matrices(candidates["v"])
        numbers, own_ids = queries["anchor"].to_numpy(), queries["vec_id"].to_numpy()
        for d, (of, q) in grid.matrices(queries["v"]).items():
            if d not in theirs:
                continue
            at, x = theirs[d]
            for a in range(0, len(q), QUERIES):
                search = Searcher(q[a : a + QUERIES], np.full(len(q[a : a + QUERIES]), -np.inf), keep + 1)
                for i in range(0, len(at), 2048):
                    search.add(ids[at[i : i + 2048]], x[i : i + 2048], np.arange(i, min(i + 2048, len(at))))
                for j, best in enumerate(search.best, a):
                    for score, vec, row in best:
                        left = int(times[at[row]]) - (vec == own_ids[of[j]] and bool((x[row] == q[j]).all()))
                        if left:
                            found.append((int(numbers[of[j]]), -score, vec, left))
        columns = zip(*found, strict=True) if found else [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor", "score", "vec_id", "times"])

    return run


def top_k(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` (over ``vec_id``) its k best others."""
    table = written(grid.counted(grid.narrow(grid.quantised(rows, id_col, vector_col, scale))), "vectors")
    queries = written(table.where(is_query).withColumn("anchor", F.monotonically_increasing_id()), "queries")
    found = grid.cells(queries.select("anchor", "vec_id", "v"), table, _cell(k), "anchor long, score long, vec_id long, times long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    first = found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")
    each = first.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k))))).drop("_copy", "times")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asked = queries.select("anchor", F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_copy"))
    out = written(asked.join(ranked, "anchor").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "found")
    discard(table, queries)
    return out
