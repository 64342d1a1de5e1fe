"""Connected components of a distributed edge table: local forests, then large and small stars.

Each task first replaces its edges by a forest: every node it has met points to the smallest node
that it reaches within the task.  That loses no connection and shortens paths to one step wherever
edges meet in a task, so few rounds of alternating large and small stars follow; their number
grows with the logarithm of the longest path that is left.  Every round is one grouped minimum
(combined before the shuffle) and a join, and is written to the shared folder; only a count and a
checksum of the edges come to the driver.  Up to ``TOGETHER`` edges, by count, one task's
forest is the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrill.llm.shared import discard, mapped, written

#: Edges of one forest: a task holds no more at a time (some 100 MB).
TOGETHER = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the roots, with the smallest node that it reaches over the edges ``u, v``."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        if np.array_equal(root, before):
            break
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _forests(edges: DataFrame) -> DataFrame:
    """The edges of each task as forests of at most ``TOGETHER`` edges each."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            u, v = forest(*(np.concatenate([h[x] for h in held]) for x in (0, 1)))
            held.clear()
            return u, v

        def out(u, v):
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            if sum(len(h[0]) for h in held) > TOGETHER:
                u, v = merged()
                if len(u) > TOGETHER // 2:
                    yield out(u, v)
                else:
                    held.append((u, v))
        if held:
            yield out(*merged())

    return mapped(edges, run, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v); u's smallest neighbour (or u itself) becomes the end of its edges."""
    if large:
        directed = edges.union(edges.select("v", "u"))
    else:
        directed = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = directed.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("_m", "u").alias("_m"))
    joined = directed.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("_m").alias("v")).union(least.select("u", F.col("_m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: every node of an edge but the roots themselves, with the smallest node it reaches.

    ``edges`` has two long columns ``u`` and ``v``.  Edges from a node to itself are ignored; a
    null end is none.
    """
    now = written(_forests(edges.select("u", "v").where("u <> v")), "edges")
    named = lambda e: e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if now.count() <= TOGETHER:
        whole = written(_forests(now.coalesce(1)), "roots")
        discard(now)
        return named(whole)
    before = None
    while True:
        last, now = now, written(_star(_star(now, True), False), "edges")
        discard(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return named(now)
        before = state
