"""Samples are bounded in rows, and no group is lost, whatever ids repeat."""

import numpy as np
from pyspark.sql import functions as F

from tallyrill.llm import language, samples

DOC = "doc_id long, text string, lang string"


def test_first_by_hash_against_sorting(spark):
    rng = np.random.default_rng(2)
    rows = [(["a", "b", None, "c"][int(rng.integers(4))], int(h)) for h in rng.integers(-(1 << 63), 1 << 63, 4000)]
    rows += [("a", -(1 << 63)), ("a", (1 << 63) - 1), ("z", 5), ("z", 5), ("z", 5)]
    df = spark.createDataFrame(rows, "g string, _h long").repartition(7)
    for bounds in (20, {"a": 50, "z": 2, "none": 3}):
        want = {}
        for g in ("a", "b", "c", "z"):
            most = bounds if isinstance(bounds, int) else bounds.get(g, 0)
            if found := sorted({h for x, h in rows if x == g})[:most]:
                want[g] = found
        got = {}
        for r in samples.first_by_hash(df, "g", bounds).collect():
            got.setdefault(r["g"], []).append(r["_h"])
        assert {g: sorted(h) for g, h in got.items()} == want
    assert samples.first_by_hash(df.limit(0), "g", 5).count() == 0


def test_more_groups_than_a_task_holds(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 300).cast("string").alias("g"), F.col("id").alias("_h"))
    assert samples.first_by_hash(df, "g", 3).count() == 900


def test_one_id_on_twenty_thousand_rows(spark):
    rng = np.random.default_rng(3)
    english, french = ["the", "and", "house", "with"], ["les", "des", "été", "maison"]
    text = lambda words: " ".join(rng.choice(words, 8))
    rows = [(7, text(english), "en") for _ in range(20_000)] + [(100 + i, text(french), "fr") for i in range(100)]
    df = spark.createDataFrame(rows, DOC)
    names, windows, labels = language.sampled_windows(df, F.lit(True), "text", "lang", "doc_id", 400, 12)
    assert names == ["en", "fr"] and 300 <= (labels == 0).sum() <= 400 and (labels == 1).sum() <= 100 and len(windows) == len(labels)
    marks = spark.createDataFrame([(7, 1), (7, 0), *((100 + i, 0) for i in range(100)), (None, 1), (8, None)], "doc_id long, toxic int")
    got = samples.labelled(df, marks, "toxic", {1: 10, 0: 30}).groupBy("label").agg(F.count("*").alias("n")).collect()
    assert {r["label"]: r["n"] for r in got} == {1: 1, 0: 30}
    again = [samples.labelled(x, marks, "toxic", {1: 10, 0: 30}).orderBy("doc_id").collect() for x in (df, df.repartition(5))]
    assert again[0] == again[1]
    assert samples.labelled(df.limit(0), marks, "toxic", {1: 10}).count() == 0
