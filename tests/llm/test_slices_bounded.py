"""Slices are written in row groups of about a slice, so a task holds no more of them however many it writes."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tallyrill.llm import cross_entropy


def test_a_row_group_is_a_slice_or_two(spark, monkeypatch):
    monkeypatch.setattr(cross_entropy, "SLICE", 20_000)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.md5(F.concat(F.col("id").cast("string"), i.cast("string")))), " ")
    rows = spark.range(2000).coalesce(1).select(F.col("id").alias("doc_id"), F.lit(False).alias("flag"), text.alias("text"))
    kept = []
    monkeypatch.setattr(cross_entropy, "discard", lambda *tables: kept.extend(tables))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert cross_entropy.score(rows.drop("flag"), labels).count() == 2000
    slices = kept[0]
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{slices.written_to.removeprefix('file:').replace('//', '/')}/*.parquet")]
    assert sum(f.num_rows for f in files) > 20
    assert max(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) <= 3
