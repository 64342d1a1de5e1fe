"""The quality model is fitted on all trusted documents, whether their ids are broadcast or joined by sorting."""

import pytest
from pyspark.sql import functions as F

from tallyrill.llm import quality


@pytest.mark.parametrize("most", [2_000_000, 10])
def test_every_trusted_document_counts(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "TRUSTED", most)
    n = 14_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lpad(F.col("id").cast("string"), 5, "0").alias("text"), F.lit("en").alias("lang"))
    labels = df.select("doc_id", F.lit(1).alias("quality"))
    judge = quality.Judge(df, labels)
    fitted = df.where(F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)) == 0).count()
    whole = judge.model.where("part = 'p' AND k = 5").where(F.shiftright("key", 4 * judge.letters.bits) != 0).count()
    assert whole == fitted > 6000  # windows without a boundary: one a document
