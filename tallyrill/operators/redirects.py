"""Redirects as a graph: where each URL ends, by pointer doubling.

A table of ``url, location`` says where a URL sends its visitor.  In round ``k`` every URL that has not arrived jumps to where its
target had got in round ``k - 1``, so it has followed ``2**k`` redirects: a chain of ``n`` takes log ``n`` joins, not ``n``.  Once more than
``hops`` have been followed, what still goes on is beyond the cap.  What goes on after as many redirects as any chain
of the remaining URLs could have is on its way to a cycle.  Rounds are written, and only URLs that go on are joined again.

Defined cases: a null URL is no edge; a null location ends there; of several locations of a URL the smallest counts; repeated rows
are one edge; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrill.functions.urls import resolved
from tallyrill.scratch import discard, written


def redirect_edges(moves: DataFrame, url_col: str = "url", location_col: str = "location") -> DataFrame:
    """``url, target``: one absolute target for each URL; relative locations are resolved against their URL."""
    pairs = moves.select(F.col(url_col).alias("url"), resolved(F.col(url_col), F.col(location_col)).alias("target"))
    return pairs.where("url is not null and target is not null").groupBy("url").agg(F.min("target").alias("target"))


def followed(moves: DataFrame, url_col: str = "url", location_col: str = "location", hops: int = 10, cycles: bool = True) -> DataFrame:
    """``url, final_url, n_hops, verdict`` for each URL that moves.

    ``verdict``: ``ok``, ``too many`` (beyond ``hops``) or ``cycle``; the last two have no final URL, and a cycle no number of hops.
    Without ``cycles`` those count as too many, and only log ``hops`` rounds run."""
    edges = written(redirect_edges(moves, url_col, location_col), "edges")
    goes_on = edges.select(F.col("url").alias("_next"), F.lit(True).alias("_on"))
    at = edges.join(goes_on, F.col("target") == F.col("_next"), "left")
    state = written(at.select("url", F.col("target").alias("at"), F.lit(1).cast("long").alias("n"), F.coalesce("_on", F.lit(False)).alias("on")), "jumps")
    tables, reach = [edges, state], 1

    def run(until: int) -> int:
        """Rounds until all have arrived or followed so many redirects; how many go on."""
        nonlocal state, reach
        while (left := state.where("on").count()) and reach < until:
            jump = state.select(F.col("url").alias("_next"), F.col("at").alias("_at"), F.col("n").alias("_n"), F.col("on").alias("_on"))
            moved = state.where("on").join(jump, F.col("at") == F.col("_next"))
            moved = moved.select("url", F.col("_at").alias("at"), (F.col("n") + F.col("_n")).alias("n"), F.col("_on").alias("on"))
            state = written(moved.union(state.where("not on")), "jumps")
            tables.append(state)
            reach *= 2
        return left

    left = run(hops + 1)
    if left and cycles:
        run(reach + left)  # no chain of those left is longer
    found = state.withColumn("verdict", F.when(F.col("on"), "cycle" if cycles else "too many").when(F.col("n") > hops, "too many").otherwise("ok"))
    out = written(found.select("url", F.when(F.col("verdict") == "ok", F.col("at")).alias("final_url"), F.when(F.col("verdict") != "cycle", F.col("n")).alias("n_hops"), "verdict"), "redirects")
    discard(*tables)
    return out
