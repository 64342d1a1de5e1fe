"""Written tables, and what several passes say of a text."""

import os

import pytest
from pyspark.sql import functions as F

from tallyrill.llm import components, shared


def test_a_cluster_must_name_its_shared_folder():
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster)


def test_discarded_tables_are_gone_and_settings_as_before(spark):
    before = spark.conf.get(shared.CLEANUP, "false")
    kept, gone = (shared.written(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "t") for _ in "ab")
    assert spark.conf.get(shared.CLEANUP, "false") == before
    path = gone.written_to.removeprefix("file://")
    assert os.path.isdir(path)
    shared.discard(gone)
    assert not os.path.exists(path) and kept.count() == 7 and kept.count() == 7


def test_passes_add_up_by_text(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, ""), (4, "bb")], "id long, text string").selectExpr("id", "text", "id AS n")
    passes = [lambda texts, k=k: texts.select("_text_hash", (F.coalesce(F.length("text"), F.lit(0)) * k).alias("n_k")) for k in (1, 10)]
    got = shared.in_passes(df, "text", ["id", "n"], passes, [F.sum("n_k").alias("total")])
    assert got.columns == ["id", "n", "total"]
    assert sorted(map(tuple, got.collect())) == [(1, 1, 11), (1, 1, 11), (2, 2, 0), (3, 3, 0), (4, 4, 22)]


def test_components_beyond_one_task(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(120)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (300, 250), (300, 260)]
    monkeypatch.setattr(components, "TOGETHER", 30)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()}
    assert got == {i: 0 for i in range(1, 121)} | {i: 1000 for i in range(1001, 1200)} | {260: 250, 300: 250}
