"""Interval lookup by a table: for each row the first of the intervals that hold its key, by a sorted merge.

The order of intervals decides among those that overlap, so a table of intervals stands for a chain of conditions of any length.
Intervals are first made disjoint: the key space is cut at quantiles of the lower ends into buckets, each interval goes to the buckets
that it meets, and a sweep of one bucket's ends, with a heap of the open intervals by order, gives the stretches that each one
wins.  Then rows and stretches are sorted together by bucket and key, and each row takes the last stretch that begins at or before it.

*Scale.*  Rows are shuffled once, by bucket and part; nothing is broadcast, and no row is compared with more than one stretch.  Rows are counted by
bucket first, and a bucket of many rows is dealt into parts, each with the bucket's stretches, so a key with a third of all rows is no
hot group.  At most ``MOST`` cuts come to the driver.  An interval costs a row for each bucket that it meets; many intervals as wide as the key
space would cost ``MOST`` rows each.

Defined cases: keys and ends are whole numbers; a null key, and a key in no interval, has null values; an interval with a null end, or
whose lower end is above its upper end, holds nothing; equal orders are settled by ends and values; repeated rows are looked up each; empty tables of rows give no rows,
empty tables of intervals null values.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrill.scratch import written

#: Intervals and rows of a bucket or part, about; most cuts.
INTERVALS, ROWS, MOST = 4096, 1_000_000, 1023


def _bucket(key: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below the key, by a tree of comparisons."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < cuts[middle], within(low, middle)).otherwise(within(middle + 1, high))

    return within(0, len(cuts))


def _stretches(part: pd.DataFrame) -> pd.DataFrame:
    """The stretches of one bucket that the intervals win, by order."""
    rows = part.sort_values(["_low", "_order", "_high"], kind="stable")
    low, high, order = (rows[c].tolist() for c in ("_low", "_high", "_order"))
    ends = sorted({*low, *(h + 1 for h in high)})
    out: list[list[int]] = []  # begin, end, place of the interval
    heap: list[tuple] = []
    at = 0
    for begin, end in zip(ends, ends[1:], strict=False):
        while at < len(low) and low[at] <= begin:
            heapq.heappush(heap, (order[at], low[at], high[at], at))
            at += 1
        while heap and heap[0][2] < begin:
            heapq.heappop(heap)
        if heap:
            place = heap[0][3]
            if out and out[-1][2] == place and out[-1][1] == begin - 1:
                out[-1][1] = end - 1
            else:
                out.append([begin, end - 1, place])
    begin, end, place = zip(*out, strict=True) if out else ((), (), ())
    found = rows.iloc[list(place)].reset_index(drop=True)
    return found.assign(_low=begin, _high=end).astype({"_low": "int64", "_high": "int64"}) if len(found) else rows.iloc[:0]


def disjoint(intervals: DataFrame, low: str, high: str, order: str, values: list[str], cuts: list[int]) -> DataFrame:
    """``_bucket, _low, _high, _value``: by bucket, the stretches that hold one interval's ``values`` (a struct)."""
    ready = intervals.select(F.col(low).cast("long").alias("_low"), F.col(high).cast("long").alias("_high"), F.col(order).alias("_order"), F.to_json(F.struct(*values)).alias("_tie"), F.struct(*values).alias("_value")).where("_low <= _high")
    meets = ready.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col("_low"), cuts), _bucket(F.col("_high"), cuts))))
    edge = F.array(*(F.lit(c).cast("long") for c in cuts)) if cuts else F.array().cast("array<bigint>")
    begin, end = F.get(edge, F.col("_bucket") - 1), F.get(edge, F.col("_bucket")) - 1
    clipped = meets.select("_bucket", F.greatest("_low", begin).alias("_low"), F.least("_high", end).alias("_high"), F.struct("_order", "_low", "_high", "_tie").alias("_place"), "_value")
    numbered = clipped.withColumn("_order", F.row_number().over(Window.partitionBy("_bucket").orderBy("_place")))
    won = numbered.select("_bucket", "_low", "_high", "_order").groupBy("_bucket").applyInPandas(_stretches, "_bucket int, _low long, _high long, _order int")
    return won.join(numbered.select("_bucket", "_order", "_value"), ["_bucket", "_order"]).select("_bucket", "_low", "_high", "_value")


def range_lookup(rows: DataFrame, key: str, intervals: DataFrame, low: str, high: str, order: str, values: list[str]) -> DataFrame:
    """``rows`` with the columns ``values`` of the first interval, by ``order``, with ``low <= key <= high``."""
    if clash := {v.lower() for v in values} & {c.lower() for c in rows.columns}:
        raise ValueError(f"columns {sorted(clash)} are in both tables")
    sound = intervals.where(F.col(low) <= F.col(high))
    wanted = min(MOST, sound.count() // INTERVALS)
    cuts: list[int] = []
    if wanted:
        cuts = sorted(set(sound.agg(F.percentile_approx(F.col(low).cast("long"), [(i + 1) / (wanted + 1) for i in range(wanted)], 100 * (wanted + 1))).first()[0]))
    stretches = written(disjoint(sound, low, high, order, values, cuts), "stretches")
    placed = rows.select(F.col(key).cast("long").alias("_key"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row")).withColumn("_bucket", F.coalesce(_bucket(F.col("_key"), cuts), F.lit(0)))
    sizes = {r["_bucket"]: r["n"] for r in placed.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
    parts = F.get(F.array(*(F.lit(max(1, -(-sizes.get(b, 0) // ROWS))) for b in range(len(cuts) + 1))), F.col("_bucket"))
    value = stretches.schema["_value"].dataType
    dealt = placed.select("_bucket", F.pmod(F.xxhash64("_row"), parts).cast("int").alias("_part"), "_key", F.lit(1).alias("_kind"), "_row", F.lit(None).cast(T.LongType()).alias("_high"), F.lit(None).cast(value).alias("_value"))
    ends = stretches.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    ends = ends.select("_bucket", F.col("_part").cast("int").alias("_part"), F.col("_low").alias("_key"), F.lit(0).alias("_kind"), F.lit(None).cast(placed.schema["_row"].dataType).alias("_row"), "_high", "_value")
    so_far = Window.partitionBy("_bucket", "_part").orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.last(F.when(F.col("_kind") == 0, F.struct("_high", "_value")), ignorenulls=True).over(so_far)
    met = dealt.union(ends).withColumn("_met", begun).where("_kind = 1")
    held = F.when(F.col("_met._high") >= F.col("_key"), F.col("_met._value"))
    return met.select("_row.*", *(held[v].alias(v) for v in values))
