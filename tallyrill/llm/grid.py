"""Blocks of one table against blocks of another: a bounded cell a task, without the driver.

Anchors are dealt to ``A`` parts and candidates to ``C`` parts by a hash of the whole row; cell ``(a, c)`` meets one part of
either.  Parts are measured: a cell holds about ``ANCHORS`` and ``CANDIDATES`` vector components.  Each
anchor is sent ``C`` times and each candidate ``A`` times, which for ``n`` rows is less by the size of a
part than one row for each pair, and no list of anchors, however long, is collected or broadcast.  Equal rows come once, with
the number of ``times`` they occur, so copies make no hot part.

A lost executor costs its cells, as both tables lie in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrill.llm.shared import pick

#: Components of a part; a worker holds a part as doubles.
ANCHORS, CANDIDATES = 1 << 21, 1 << 22
#: Components up to here in size travel as two bytes.
SHORT = 1 << 15
SAFE = float(1 << 53)


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: float, extra: dict[str, str] | None = None) -> DataFrame:
    """``vec_id, v`` with components ``floor(scale * x)`` of the rows that take part, and the columns ``extra``."""
    scaled = F.transform("_v", lambda x: x.cast("double") * scale)
    fine = F.col("_v").isNotNull() & F.col("_id").isNotNull() & (F.size("_v") > 0) & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    floors = F.transform(scaled, lambda x: F.when(F.abs(x) < SAFE, F.floor(x).cast("double")).otherwise(x))  # doubles beyond are whole, and may be no longs
    named = pick(rows, {"_id": id_col, "_v": vector_col} | {f"_e_{n}": c for n, c in (extra or {}).items()})
    return named.where(fine).select(F.col("_id").cast("long").alias("vec_id"), floors.alias("v"), *(F.col(f"_e_{n}").alias(n) for n in extra or {}))


def counted(rows: DataFrame) -> DataFrame:
    """Equal rows once, with ``times``."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("times"))


def parts(rows: DataFrame, components: int, least: int = 1) -> int:
    """Into how many parts of about ``components`` the vectors ``v`` go; ``least``, but for tables too small to be cut so finely."""
    size, n = rows.agg(F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0)), F.count("*")).first()
    return max(1, -(-size // components), min(least, n // 1024))


def narrow(rows: DataFrame) -> DataFrame:
    """Vectors of small whole components as two bytes each."""
    most = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    return rows.withColumn("v", F.col("v").cast("array<short>")) if most is not None and most < SHORT else rows


def cells(anchors: DataFrame, candidates: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """The rows of ``run(part of anchors, part of candidates)`` over all cells; both tables have ``v`` and are written."""
    context = anchors.sparkSession.sparkContext
    a = parts(anchors, ANCHORS)
    c = parts(candidates, CANDIDATES, -(-2 * context.defaultParallelism // a))

    def dealt(rows: DataFrame, own: int, others: int, cell: Callable[[Column, Column], Column]) -> DataFrame:
        placed = rows.withColumn("_own", F.pmod(F.xxhash64(*rows.columns), F.lit(own)).cast("int"))
        each = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return each.withColumn("_cell", cell(F.col("_own"), F.col("_other"))).drop("_own", "_other").repartition(a * c, "_cell")

    left = dealt(anchors, a, c, lambda own, other: own * c + other)
    right = dealt(candidates, c, a, lambda own, other: other * c + own)
    return left.groupBy("_cell").cogroup(right.groupBy("_cell")).applyInArrow(lambda x, y: run(x.drop(["_cell"]), y.drop(["_cell"])), schema)


def matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: the row numbers and the vectors, as doubles."""
    whole = column.combine_chunks()
    whole = whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks or [pa.array([], whole.type)])
    length = np.diff(whole.offsets.to_numpy())
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else length
    out = {}
    for d in np.unique(length).tolist():
        at = np.flatnonzero(length == d)
        out[d] = (at, flat[start[at][:, None] + np.arange(d)].astype(float))
    return out


def whole_products(q: np.ndarray, x: np.ndarray) -> list[int]:
    """Inner products of one vector with many in Python's integers, for components whose products pass 2**53."""
    own = [int(c) for c in q]
    return [max(-(1 << 63), min((1 << 63) - 1, sum(a * int(b) for a, b in zip(own, row, strict=True)))) for row in x]
