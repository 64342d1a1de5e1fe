"""Column profiles that add up: sketches stored with exact counts, a row for each part of a table and column.

A profile of a part (a day, a file, a source) is made once, from one pass over the part, and kept.  Profiles of any parts are merged
without reading their rows again: counts add, extremes are compared, and sketches are united, which gives the sketch of all rows
together, as its registers are maxima.  Distinct values are estimated within ``error`` (three deviations of the sketch's size).
What two parts share is estimated from theta sketches, which can be intersected.

Defined cases: nulls are blank, and blank is one of the distinct values, as in ``tabular.column_stats``; an empty part has no profile; merging no profiles gives no
rows; repeated rows count each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of the number of registers.
SIZE = 12


def error(size: int = SIZE) -> float:
    """Relative error of an estimate, three deviations."""
    return 3 * 1.04 / math.sqrt(1 << size)


def profiles(df: DataFrame, part: Column, columns: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """``part, column_name, total_rows, blanks, least, most, sketch, theta`` of each part, from one pass."""
    names = columns or df.columns
    texts = df.select(part.cast("string").alias("part"), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"_{i}") for i, c in enumerate(names)))
    made = []
    for i in range(len(names)):
        c = F.col(f"_{i}")
        told = F.concat(F.lit("="), c)  # sketches pass over empty texts
        made += [F.count_if(c == "").alias(f"b{i}"), F.min(F.when(c != "", c)).alias(f"l{i}"), F.max(F.when(c != "", c)).alias(f"m{i}"), F.hll_sketch_agg(told, size).alias(f"s{i}"), F.theta_sketch_agg(told, size).alias(f"t{i}")]
    got = texts.groupBy("part").agg(F.count("*").alias("n"), *made)
    row = lambda i, c: F.struct(F.lit(c).alias("column_name"), F.col("n").alias("total_rows"), *(F.col(f"{k}{i}").alias(n) for k, n in (("b", "blanks"), ("l", "least"), ("m", "most"), ("s", "sketch"), ("t", "theta"))))
    return got.select("part", F.explode(F.array(*(row(i, c) for i, c in enumerate(names)))).alias("r")).select("part", "r.*")


def merged(stored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Profiles of the rows of all parts together, by ``by`` and column."""
    sums = [F.sum("total_rows").alias("total_rows"), F.sum("blanks").alias("blanks"), F.min("least").alias("least"), F.max("most").alias("most")]
    return stored.groupBy(*(by or []), "column_name").agg(*sums, F.hll_union_agg("sketch").alias("sketch"), F.theta_union_agg("theta").alias("theta"))


def estimates(stored: DataFrame) -> DataFrame:
    """Adds ``distinct_values``, an estimate."""
    return stored.withColumn("distinct_values", F.hll_sketch_estimate("sketch"))


def shared_values(stored: DataFrame, one: str, other: str) -> DataFrame:
    """``column_name, shared_values``: an estimate of how many distinct values two parts have in common."""
    a, b = (stored.where(F.col("part") == p).select("column_name", F.col("theta").alias(n)) for p, n in ((one, "a"), (other, "b")))
    return a.join(b, "column_name").select("column_name", F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("shared_values"))
