"""Tabular work: column statistics, slices, unions, keep-first, cleaning.

Where the order of rows matters, ``order`` names the column that gives it (unique, or ties are
arbitrary): Parquet has no order of its own.
"""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyrill.functions.text import strip, title_case
from tallyrill.scratch import written


def _col(name: str):
    return F.col(f"`{name}`")


def column_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """``column_name, total_rows, blanks, distinct_values``: nulls are blanks, and blank is a value.

    One pass for the counts; exact distinct counts are made from distinct (column, value) pairs,
    which are combined before the shuffle.
    """
    names = [c for c in df.columns if c != "_ord"]
    texts = df.select(*(F.coalesce(_col(c).cast("string"), F.lit("")).alias(c) for c in names))
    if approximate:
        stats = texts.agg(F.count("*").alias("_n"), *(F.count_if(_col(c) == "").alias(f"b{i}") for i, c in enumerate(names)), *(F.approx_count_distinct(_col(c)).alias(f"d{i}") for i, c in enumerate(names)))
        rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("_n").alias("total_rows"), F.col(f"b{i}").alias("blanks"), F.col(f"d{i}").alias("distinct_values")) for i, c in enumerate(names))))
        return stats.select(rows.alias("r")).select("r.*")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), _col(c).alias("v")) for c in names)))
    values = texts.select(cells.alias("c")).select("c.*").groupBy("column_name", "v").agg(F.count("*").alias("n"))
    return values.groupBy("column_name").agg(F.sum("n").alias("total_rows"), F.coalesce(F.sum(F.when(F.col("v") == "", F.col("n"))), F.lit(0)).alias("blanks"), F.count("*").alias("distinct_values"))


def positioned(df: DataFrame, order: list[str], per_range: int = 1_000_000) -> DataFrame:
    """All rows with ``_range`` and ``_position``, from 1 by ``order`` (whose values together are unique).

    No task ranks more than about ``per_range`` rows: larger tables are sorted into as many ranges as that takes and written, the ranges are counted,
    and the rows before a range are added to the place within it.  The counts, a row for each range, stay a table.
    """
    ranges = -(-df.count() // per_range)
    if ranges <= 1:
        return df.withColumn("_range", F.lit(0)).withColumn("_position", F.row_number().over(Window.partitionBy("_range").orderBy(*map(_col, order))).cast("long"))
    dealt = written(df.repartitionByRange(ranges, *map(_col, order)).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*map(_col, order)))
    return dealt.withColumn("_place", place).join(before, "_range").withColumn("_position", F.col("_before") + F.col("_place")).select(*map(_col, df.columns), "_range", "_position")


def slice_rows(df: DataFrame, spec: str | None, order: str, per_range: int = 1_000_000) -> DataFrame:
    """``n``: the first n rows; ``a-b``: rows a to b from 1; anything else warns and keeps all."""
    if not spec:
        return df
    if spec.isdigit():
        return df.orderBy(_col(order)).limit(int(spec))
    m = re.fullmatch(r"(\d+)-(\d+)", spec)
    if not m:
        warnings.warn(f"row range {spec!r} is not understood; all rows are kept", stacklevel=2)
        return df
    first, last = max(1, int(m[1])), int(m[2])
    if last <= per_range:  # a bounded head, sorted in part by every task
        head = df.orderBy(_col(order)).limit(last)
        return head.withColumn("_position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(_col(order)))).where(F.col("_position") >= first).drop("_position")
    places = positioned(df.select(_col(order)), [order], per_range).where(F.col("_position").between(first, last))
    ends = places.agg(F.min(_col(order)), F.max(_col(order))).first()  # of the order alone; the rows between are then read by it
    return df.where(_col(order).between(F.lit(ends[0]), F.lit(ends[1]))) if ends[0] is not None else df.limit(0)


def merge_tables(tables: list[DataFrame]) -> DataFrame:
    """Union by name; texts are blank-filled before, so a column that a table lacks stays null there."""
    if not tables:
        raise ValueError("nothing to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.na.fill("") for t in tables])


def known_keys(df: DataFrame, keys: list[str]) -> list[str]:
    """The keys that are columns; others warn."""
    if missing := [k for k in keys if k not in df.columns]:
        warnings.warn(f"no columns {missing}; they are left out of the key", stacklevel=3)
    return [k for k in keys if k in df.columns]


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``; null is a key value and differs from blank.

    A key's rows are cut to one before the shuffle (the rank limit is pushed below it).
    """
    keys = known_keys(df, keys)
    if not keys:
        return df
    place = F.row_number().over(Window.partitionBy(*map(_col, keys)).orderBy(order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def dedup_statistics(df: DataFrame, keys: list[str]) -> DataFrame:
    """``before, after, removed``."""
    groups = df.groupBy(*map(_col, keys)).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"), F.count("*").alias("after")).withColumn("removed", F.col("before") - F.col("after"))


def clean(df: DataFrame, trim: bool = True, title_cols: list[str] | None = None) -> DataFrame:
    """Texts blank-filled, stripped, and those of ``title_cols`` in title case."""
    wanted = set(title_cols or [])
    out = []
    for f in df.schema:
        c = _col(f.name)
        if isinstance(f.dataType, StringType):
            c = F.coalesce(c, F.lit(""))
            c = strip(c) if trim else c
            c = title_case(c) if f.name in wanted else c
        out.append(c.alias(f.name))
    return df.select(*out)
