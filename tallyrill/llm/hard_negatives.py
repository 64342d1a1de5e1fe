"""Hard negatives by bit-sliced integer products.

A component ``x`` is an integer in two's complement; its bit-planes are taken most significant first.  With the planes
from ``b`` up, a product with the anchor ``q`` is known but for what the lower planes may add, which lies between
``(2**b - 1)`` times the sum of ``q``'s negative and of its positive components.  So each plane
halves the interval that holds a score; a candidate is dropped once its interval meets no window of the anchor.  While more
than ``SPARSE`` of a block's pairs are open a plane is one matrix product; beyond, it is a sum over the open pairs.
The sign and the ``HEAD - 1`` planes below it, which leave intervals too wide to drop anything, are one product.
After the last plane scores are exact, and nothing is lost.

*Positives.*  An anchor's one window is open above, and closed below by its k-th best of its own label so far.
*Negatives.*  Each positive score ``p`` opens the window ``50 p <= 100 s <= 95 p`` over rows of other labels, closed from
below by the third best within it so far.

Anchors meet candidates by cells (:mod:`tallyrill.llm.grid`): each cell keeps a few rows for each of its anchors, and a
ranking by anchor merges the cells' rows.

Defined cases: a row takes no part if its id, label or vector is null, its vector is empty or holds a null or non-finite component (or one whose
scaled value is beyond a double); vectors of different lengths have no score with each other; an anchor never meets its own
row, but another row equal to it counts, and rows that repeat are positives, negatives and anchors as often
as they occur; ties go to the smaller id; a positive without negatives in its window, and an anchor without
positives, give no rows; a positive score below 0 opens no window.  Products that pass 2**53 are taken in Python's
integers; a score outside the range of a long counts as the nearest long.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrill.llm import grid
from tallyrill.llm.shared import discard, pick, written

HEAD = 4
SPARSE = 0.05
#: Anchors and candidates of a block of pairs.
ROWS, COLUMNS = 256, 2048
#: A candidate found: score, id, times.
Found = tuple[int, int, int]


def planes(x: np.ndarray) -> int:
    """Bits of two's complement that hold all integers of ``x``."""
    return 1 + max(int(x.max(initial=0)).bit_length(), int(-1 - x.min(initial=0)).bit_length())


class Windows:
    """Per anchor, the best ``keep`` candidates of each of its windows of scores."""

    def __init__(self, ids: np.ndarray, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int, own_row: bool) -> None:
        self.ids, self.q, self.keep, self.own_row = ids, anchors, keep, own_row
        self.low, self.high = low.astype(float), high.astype(float)
        self.ends = np.minimum(anchors, 0).sum(1), np.maximum(anchors, 0).sum(1)
        self.best: list[list[list[tuple]]] = [[[] for _ in w] for w in low]
        self.pairs = self.terms = 0  # pairs met, and products of a pair with a plane

    def _open(self, rows: np.ndarray, scores: np.ndarray, b: int, dense: bool) -> np.ndarray:
        """Whose interval meets a window of its anchor."""
        shape = (lambda x: x[:, None]) if dense else (lambda x: x)
        rest = float((1 << b) - 1)
        least, most = (scores + rest * shape(end[rows]) for end in self.ends)
        out = np.zeros(scores.shape, bool)
        for w in range(self.low.shape[1]):
            out |= (least <= shape(self.high[rows, w])) & (most >= shape(self.low[rows, w]))
        return out

    def survivors(self, rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, candidate and exact score of the pairs that may enter a window."""
        q, whole = self.q[rows], x.astype(np.int64)
        b = max(0, planes(whole) - HEAD)
        plane = lambda b: (((whole >> b) & 1) << b).astype(float)
        scores = q @ ((whole >> b) << b).astype(float).T
        self.pairs += scores.size
        self.terms += scores.size
        alive = self._open(rows, scores, b, True)
        while b and np.count_nonzero(alive) > SPARSE * alive.size:
            b -= 1
            scores += q @ plane(b).T
            self.terms += scores.size
            alive = self._open(rows, scores, b, True)
        i, j = np.nonzero(alive)
        scores = scores[i, j]
        while b and len(i):
            b -= 1
            scores = scores + np.einsum("ij,ij->i", q[i], plane(b)[j])
            self.terms += len(i)
            still = self._open(rows[i], scores, b, False)
            i, j, scores = i[still], j[still], scores[still]
        return rows[i], j, scores

    def add(self, rows: np.ndarray, ids: np.ndarray, times: np.ndarray, x: np.ndarray) -> None:
        """Candidates ``x`` for the anchors ``rows``."""
        if not len(rows) or not len(x):
            return
        if np.abs(self.q[rows]).max() * np.abs(x).max() * x.shape[1] >= grid.SAFE:
            for i in rows.tolist():
                self._enter(i, ids, times, x, np.array(grid.whole_products(self.q[i], x), object))
            return
        for r in range(0, len(rows), ROWS):
            for c in range(0, len(x), COLUMNS):
                at, j, scores = self.survivors(rows[r : r + ROWS], x[c : c + COLUMNS])
                cuts = np.flatnonzero(np.diff(at, prepend=-1))
                for a, e in pairwise([*cuts.tolist(), len(at)]):
                    some = c + j[a:e]
                    self._enter(int(at[a]), ids[some], times[some], x[some], scores[a:e])

    def _enter(self, i: int, ids: np.ndarray, times: np.ndarray, x: np.ndarray, scores: np.ndarray) -> None:
        if self.own_row and (same := (ids == self.ids[i]) & (x == self.q[i]).all(1)).any():
            times = times - same
        for w, best in enumerate(self.best[i]):
            at = np.flatnonzero((times > 0) & (scores >= self.low[i, w]).astype(bool) & (scores <= self.high[i, w]).astype(bool))
            if len(at) > 4 * self.keep and scores.dtype != object:
                cut = np.partition(scores[at], len(at) - self.keep)[len(at) - self.keep]
                at = at[scores[at] >= cut]
            if len(at):
                best += [(-int(scores[k]), int(ids[k]), int(times[k])) for k in at]
                best.sort()
                del best[self.keep :]
                if len(best) == self.keep:
                    self.low[i, w] = max(self.low[i, w], float(-best[-1][0]) * (1 if abs(best[-1][0]) < grid.SAFE else 1 - 1e-15))

    def found(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Anchor, window, score, id and times of what the windows hold."""
        for i, windows in enumerate(self.best):
            for w, best in enumerate(windows):
                for score, vec, times in best:
                    yield i, w, -score, vec, times


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


FOUND = "anchor long, place long, score long, vec_id long, times long"
NAMES = ["anchor", "place", "score", "vec_id", "times"]


def _positives(count: int):
    """Each cell's best of an anchor's own label."""

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        rows, theirs = [], grid.matrices(candidates["v"])
        ids, times, labels = (candidates[c].to_numpy() for c in ("vec_id", "times", "label"))
        for d, (at, q) in grid.matrices(anchors["v"]).items():
            if d not in theirs:
                continue
            own, (there, x) = anchors["label"].to_numpy()[at], theirs[d]
            free = np.full((len(at), 1), np.inf)
            state = Windows(anchors["vec_id"].to_numpy()[at], q, -free, free, count, True)
            for label in np.unique(own):
                some = labels[there] == label
                state.add(np.flatnonzero(own == label), ids[there[some]], times[there[some]], x[some])
            numbers = anchors["anchor"].to_numpy()[at]
            rows += [(int(numbers[i]), w, *rest) for i, w, *rest in state.found()]
        return _table(rows, NAMES)

    return run


def _negatives(count: int, low: int, high: int):
    """Each cell's best of other labels within each positive's window; ``scores`` has an anchor's positive scores in order."""

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        rows, theirs = [], grid.matrices(candidates["v"])
        ids, times, labels = (candidates[c].to_numpy() for c in ("vec_id", "times", "label"))
        for d, (at, q) in grid.matrices(anchors["v"]).items():
            if d not in theirs:
                continue
            own, (there, x) = anchors["label"].to_numpy()[at], theirs[d]
            positive = anchors["scores"].take(pa.array(at)).to_pylist()
            most = max(map(len, positive))
            least, top = np.full((len(at), most), np.inf), np.full((len(at), most), -np.inf)  # a window that nothing meets
            for i, scores in enumerate(positive):
                least[i, : len(scores)] = [-((-low * p) // 100) for p in scores]
                top[i, : len(scores)] = [high * p // 100 for p in scores]
            state = Windows(anchors["vec_id"].to_numpy()[at], q, least, top, count, False)
            for label in np.unique(own):
                some = labels[there] != label
                state.add(np.flatnonzero(own == label), ids[there[some]], times[there[some]], x[some])
            numbers = anchors["anchor"].to_numpy()[at]
            rows += [(int(numbers[i]), w, *rest) for i, w, *rest in state.found()]
        return _table(rows, NAMES)

    return run


def _ranked(found: DataFrame, count: int) -> DataFrame:
    """The first ``count`` of what all cells found, repeated rows as often as they occur; adds ``rank``."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).drop("rank")  # bounds what a window over copies holds
    each = first.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(count)))))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).drop("_copy", "times")


def mine(rows: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is over ``vec_id``; ``label``, over ``vec_id`` and ``label``, is the label that counts; ``low`` and ``high`` are
    the bounds of a negative's score, in hundredths of the positive's."""
    taking = grid.quantised(rows, id_col, vector_col, scale, {"label": label_col}).where(F.col("label").isNotNull())
    taking = taking.withColumn("label", (F.col("label") if label is None else label).cast("long"))
    candidates = written(grid.counted(grid.narrow(taking)), "vectors")
    anchors = written(candidates.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    search = anchors.select("anchor", "vec_id", "v", "label")
    near = grid.cells(search, candidates, _positives(positives), FOUND)
    near = written(_ranked(near, positives).select("anchor", F.col("rank").cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("s")).select("anchor", F.transform("s", lambda p: p["positive_score"]).alias("scores"))
    windows = written(search.join(scores, "anchor").select("anchor", "vec_id", "v", "label", "scores"), "windows")
    far = grid.cells(windows, candidates, _negatives(negatives, low, high), FOUND)
    far = _ranked(far, negatives).select("anchor", (F.col("place") + 1).alias("place"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("anchor", F.col("vec_id").alias("anchor_id"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_copy"))
    out = named.join(near.join(far, ["anchor", "place"]), "anchor")
    out = written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard(candidates, anchors, near, windows)
    return out
