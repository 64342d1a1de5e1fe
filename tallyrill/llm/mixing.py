"""Mixing sources to target weights by capped water-filling.

Source ``i`` has ``size_i`` words and weight ``w_i``.  The mix shall have ``share`` times all
words.  A source's target is ``level * w_i``, but at most ``max_epochs * size_i``: sources
above their cap are clamped and the rest is shared anew by weight, until none is above.
The clamped are those whose ratio of cap to weight is at most some bound, and what the mix holds rises with
the level; so the bound is searched for among ``CUTS`` quantiles of the ratios at a time.  A round is one aggregate over the
table of sources, which stays distributed; a list of sums comes to the driver, and the number of rounds
grows with the logarithm of the number of sources.

Of a source's target, ``floor(target / size)`` whole repetitions go to each document.  The
remaining fraction is met by one more repetition of the documents that come first in the
source's order by seeded MD5: those whose middle word lies within the fraction of the
source's words.  So a source's taken words miss its target by half a document at most,
and reruns agree.  The order is made of two levels, so that a source with a third of all
rows is no single group: documents fall into up to ``MAX_BUCKETS`` ranges of the hash, the
sums of the ranges (map-side combined) give each range its offset, and only the inside
of a range is sorted.  Texts are read once and never shuffled.

Defined cases: a null text has size 0 and is taken 0 times its 0 words; a null source is a
source of its own; a source without words has target 0; if all caps together are below
the mix, every source ends at its cap; repeated rows are separate documents (of equal
rows that straddle the boundary, any may be the one taken again); an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrill.llm.shared import pick, written

ROWS_A_BUCKET, MAX_BUCKETS, CUTS = 500, 65_536, 32


def word_count(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame, key: str = "source") -> DataFrame:
    """Adds ``rank`` (from 0, by code point, null last) without bringing all rows to one task."""
    parted = written(sources.repartitionByRange(F.col(key).asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = parted.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_last()))
    return parted.withColumn("_place", place).join(offsets, "_part").withColumn("rank", F.col("_before") + F.col("_place") - 1).drop("_part", "_place", "_before")


def water_fill(sources: DataFrame, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Adds ``target`` to a table with ``source_size`` and ``weight`` (a row for each source)."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    ratio = cap / F.col("weight")
    goal = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    low, high = -1.0, float("inf")  # sources up to the one ratio are clamped, from the other on free
    while cuts := sources.where((ratio > low) & (ratio < high)).agg(F.percentile_approx(ratio, [(i + 1) / (CUTS + 1) for i in range(CUTS)], 10_000)).first()[0]:
        cuts = sorted(set(cuts))  # ratios that occur, so every round settles some
        held = sources.agg(*(F.sum(F.when(ratio <= t, cap).otherwise(F.col("weight") * t)) for t in cuts)).first()
        low = max([low, *(t for t, h in zip(cuts, held, strict=True) if h <= goal)])
        high = min([high, *(t for t, h in zip(cuts, held, strict=True) if h > goal)])
    clamped, free = sources.agg(F.sum(F.when(ratio <= low, cap)), F.sum(F.when(ratio > low, F.col("weight")))).first()
    return sources.withColumn("target", F.least(cap, F.col("weight") * ((goal - (clamped or 0.0)) / free)) if free else cap)


def mix(docs: DataFrame, weigh, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every document.

    ``weigh`` turns the table of sources (``source``, ``source_size``) into one with ``weight``.
    """
    rows = pick(docs, {"doc_id": id_col, "text": text_col, "source": source_col})
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    sized = written(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest.alias("_h"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("_s")), "sizes")
    sources = sized.groupBy("_s").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sources = written(weigh(sources), "sources")
    filled = water_fill(sources, share, max_epochs)
    buckets = min(MAX_BUCKETS, max(1, (sources.agg(F.sum("_rows")).first()[0] or 0) // ROWS_A_BUCKET))
    head = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    placed = sized.withColumn("_b", F.shiftright(head * buckets, 32))
    ranges = placed.groupBy("_s", "_b").agg(F.sum("size").alias("_sum"))
    ranges = ranges.select("_s", "_b", F.coalesce(F.sum("_sum").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    ranges = ranges.join(filled.select("_s", "source_size", "target"), "_s")
    inside = F.sum("size").over(Window.partitionBy("_s", "_b").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(epochs)
    middle = F.col("_offset") + F.col("_to") - F.col("size") / 2
    again = middle <= F.col("target") - whole * F.col("source_size")
    out = placed.withColumn("_to", inside).join(ranges, ["_s", "_b"])
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (whole + F.when(again & (F.col("target") > whole * F.col("source_size")), 1).otherwise(0))).cast("long").alias("taken"))


def cyclic_weights(weights: tuple[int, ...] = (3, 1, 2)):
    """Sources by code point, null last, get ``weights`` in turn."""

    def weigh(sources: DataFrame) -> DataFrame:
        chosen = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
        return ranked(sources).withColumn("weight", chosen).drop("rank")

    return weigh
