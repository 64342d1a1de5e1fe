"""Row ranges of files by their own ordinals: a slice opens only the files that hold it.

Parquet has no order of rows but that of its files and of the rows within them (``_metadata.row_index``).  Files come by path; each one's rows are
counted, which reads footers and no column, and a file's rows follow those of the files before it.  A slice keeps the files whose rows
overlap it, so the scan lists no others, and within them the rows whose ordinal lies in it.

Defined cases: ordinals count from 1; a range beyond the rows gives those there are; an upper bound below the lower one gives none; empty files and
folders have no ordinals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most files whose names go into a scan's own filter; beyond, the files are a table joined by path.
LISTED = 10_000


def file_offsets(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, n_rows, before``: the rows of each file, and of the files before it by path."""
    counts = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file_path")).groupBy("file_path").agg(F.count("*").alias("n_rows"))
    earlier = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return counts.withColumn("before", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)))


def with_ordinals(spark: SparkSession, path: str) -> DataFrame:
    """All rows with ``_ordinal``, from 1, without a sort or a shuffle of rows."""
    offsets = file_offsets(spark, path).select(F.col("file_path").alias("_file"), "before")
    rows = spark.read.parquet(path)
    numbered = rows.select(*(F.col(f"`{c}`") for c in rows.columns), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_index"))
    joined = numbered.join(offsets, F.col("_path") == F.col("_file"))
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("before") + F.col("_index") + 1).alias("_ordinal"))


def slice_files(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` by ordinal, with ``_ordinal``; only the files that hold them are read."""
    first = max(1, first)
    rows = spark.read.parquet(path)
    columns = [F.col(f"`{c}`") for c in rows.columns]
    held = file_offsets(spark, path).where((F.col("before") < last) & (F.col("before") + F.col("n_rows") >= first))
    found = held.limit(LISTED + 1).collect() if last >= first else []
    if len(found) > LISTED:
        return with_ordinals(spark, path).where(F.col("_ordinal").between(first, last))
    if not found:
        return rows.select(*columns, F.lit(0).cast("long").alias("_ordinal")).limit(0)
    file, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    offsets = F.create_map(*(F.lit(x) for r in found for x in (r["file_path"], r["before"])))
    picked = rows.where(file.isin([r["file_path"] for r in found]))  # of files, before any is opened
    ends = [(r["file_path"], first - 1 - r["before"], last - 1 - r["before"]) for r in found if r["before"] + 1 < first or r["before"] + r["n_rows"] > last]
    for name, low, high in ends:  # the first and the last file at most
        picked = picked.where((file != name) | at.between(low, high))
    return picked.select(*columns, (F.element_at(offsets, file) + at + 1).cast("long").alias("_ordinal"))
