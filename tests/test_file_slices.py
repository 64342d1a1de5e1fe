"""Slices of several files: which rows, and how many the scan gives."""

import pytest
from pyspark.sql import functions as F

from tallyrill.operators import file_slices


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("parts") / "t")
    for i, n in enumerate((40, 0, 25, 60)):
        spark.range(1000 * i, 1000 * i + n).withColumn("text", F.concat(F.lit("row "), "id")).coalesce(1).write.parquet(f"{path}/p={i}")
    return path


def scanned(df):
    """Rows that the scans of an executed plan gave."""
    total, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().get("numOutputRows").get().value()
        for get in ("children",):
            kids = getattr(node, get)()
            left += [kids.apply(i) for i in range(kids.size())]
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            left.append(node.executedPlan())
    return total


WANT = [i for p, n in enumerate((40, 0, 25, 60)) for i in range(1000 * p, 1000 * p + n)]


@pytest.mark.parametrize(("first", "last", "read"), [(1, 10, 40), (35, 45, 65), (41, 65, 25), (66, 66, 60), (100, 900, 60), (-5, 3, 40), (1, 125, 125), (200, 300, 0), (10, 5, 0)])
def test_a_slice_reads_the_files_that_hold_it(spark, folder, first, last, read):
    df = file_slices.slice_files(spark, folder, first, last)
    got = sorted((r["_ordinal"], r["id"]) for r in df.collect())
    assert got == [(i, WANT[i - 1]) for i in range(max(1, first), min(last, 125) + 1)]
    assert scanned(df) == read


def test_ordinals_of_all_rows_and_many_files(spark, folder, monkeypatch):
    whole = file_slices.with_ordinals(spark, folder)
    assert sorted((r["_ordinal"], r["id"]) for r in whole.collect()) == list(enumerate(WANT, 1))
    assert whole.columns == ["id", "text", "p", "_ordinal"]
    monkeypatch.setattr(file_slices, "LISTED", 1)
    assert sorted(r["id"] for r in file_slices.slice_files(spark, folder, 38, 70).collect()) == sorted(WANT[37:70])
