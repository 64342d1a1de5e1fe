"""The workbook source and sink: ranges of rows, pushed filters, commit and abort."""

import io
import os
import re
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyrill.sources import tables, xlsx

PUSH = "spark.sql.python.filterPushdown.enabled"


@pytest.fixture
def pushing(spark):
    xlsx.register(spark)
    spark.conf.set(PUSH, "true")
    yield spark
    spark.conf.unset(PUSH)


def frame(spark, n=230):
    k = F.col("id")
    return spark.range(n).select(k.cast("string").alias("key"), F.when(k % 3 != 0, F.concat(F.lit("<a & b> "), k % 7)).alias("text"), F.when(k % 2 == 0, F.lit("é\n漢")).alias("even"))


def test_round_trip_in_ranges_of_rows(spark, tmp_path):
    xlsx.register(spark)
    path = str(tmp_path / "out")
    df = frame(spark)
    df.repartition(4).write.format("xlsx").mode("append").option("sheet", "S & T").save(path)
    names = sorted(os.listdir(path))
    assert len(names) == 4 and all(n.endswith(".xlsx") for n in names)
    want = sorted(map(tuple, df.collect()), key=repr)
    for size in ("0", "1", "17", "1000"):
        back = spark.read.format("xlsx").option("rowsPerPartition", size).load(path)
        assert back.columns == ["key", "text", "even", "_ord"]
        assert sorted(map(tuple, back.drop("_ord").collect()), key=repr) == want
        assert back.rdd.getNumPartitions() == (4 if size in ("0", "1000") else 230 if size == "1" else sum(-(-r["n"] // 17) for r in per_book(path)))
    assert spark.read.format("xlsx").option("sheet", "S & T").load(f"file://{path}").count() == 230
    assert tables.read_table(spark, f"{path}/{names[0]}", sheet="S & T").where("_ord = 0").count() == 1


def per_book(path):
    out = []
    for n in os.listdir(path):
        with open(f"{path}/{n}", "rb") as f:
            out.append({"n": sum(1 for _ in xlsx.sheet_rows(f.read())) - 1})
    return out


@pytest.mark.parametrize("condition", ["key = '12'", "key in ('1', '2', '400')", "text is null", "text is not null and even is null", "text like '%b> 3%' and key like '1%'", "key like '%9' and _ord > 3", "key > '7'"])
def test_filters_reach_the_scan(pushing, tmp_path, condition):
    path = str(tmp_path / "out")
    df = frame(pushing)
    df.coalesce(1).write.format("xlsx").mode("append").save(path)
    back = pushing.read.format("xlsx").option("pushdown", "true").option("rowsPerPartition", "50").load(path)
    plain = pushing.createDataFrame([(*r, i) for i, r in enumerate(df.collect())], "key string, text string, even string, _ord long")
    got = back.where(condition)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.where(condition).collect()), key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    if condition == "key = '12'":
        assert not re.search(r"\bFilter\b", plan)


def test_rows_that_a_filter_drops_are_not_taken_apart(pushing, tmp_path, monkeypatch):
    out = io.BytesIO()
    xlsx.write_book(out, ["a", "b"], ((str(i), "x" * 20) for i in range(500)))
    path = str(tmp_path / "b.xlsx")
    with open(path, "wb") as f:
        f.write(out.getvalue())
    seen = []
    real = xlsx.Sheet.taken_apart
    monkeypatch.setattr(xlsx.Sheet, "taken_apart", lambda self, raw: seen.append(raw.count(b"<c ")) or real(self, raw))
    reader = xlsx._PushingReader({"path": path}, xlsx.XlsxSource({"path": path}).schema())
    assert [*reader.pushFilters([xlsx.EqualTo(("a",), "77"), xlsx.EqualTo(("_ord",), 3)])] == [xlsx.EqualTo(("_ord",), 3)]
    assert [*reader.read(xlsx._Part(path, 0, None))] == [("77", "x" * 20, 77)]
    assert seen.count(2) == 1 and len(seen) == 501  # whole rows: the one that holds; of the others the filtered cell
    assert [r[-1] for r in xlsx._Reader({"path": path}, xlsx.XlsxSource({"path": path}).schema()).read(xlsx._Part(path, 490, 495))] == [490, 491, 492, 493, 494]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    xlsx.register(spark)
    path = str(tmp_path / "out")
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 57, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("x"))
    with pytest.raises(PySparkException):
        bad.write.format("xlsx").mode("append").save(path)
    assert not os.path.exists(path) or os.listdir(path) == []
    good = frame(spark, 10)
    good.coalesce(1).write.format("xlsx").mode("append").save(path)
    before = os.listdir(path)
    with pytest.raises(PySparkException):
        bad.write.format("xlsx").mode("overwrite").save(path)
    assert os.listdir(path) == before


def test_overwrite_append_and_empty(spark, tmp_path):
    xlsx.register(spark)
    path = str(tmp_path / "out")
    frame(spark, 10).coalesce(1).write.format("xlsx").mode("append").save(path)
    frame(spark, 5).coalesce(1).write.format("xlsx").mode("append").save(path)
    assert spark.read.format("xlsx").load(path).count() == 15
    frame(spark, 3).coalesce(1).write.format("xlsx").mode("overwrite").save(path)
    assert spark.read.format("xlsx").load(path).count() == 3 and len(os.listdir(path)) == 1
    frame(spark, 0).coalesce(1).write.format("xlsx").mode("overwrite").save(path)
    assert spark.read.format("xlsx").load(path).count() == 0


def test_rows_beyond_a_sheet_go_on_in_the_next():
    out = io.BytesIO()
    xlsx.write_book(out, ["a", "_ord"], ((i, 0) for i in range(25)), "D", most_rows=10)
    book = out.getvalue()
    assert [[r[0] for r in xlsx.sheet_rows(book, s)] for s in ("D", "D 2", "D 3")] == [["a", *map(str, range(10))], ["a", *map(str, range(10, 20))], ["a", *map(str, range(20, 25))]]
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        assert b'width="12"' in z.read("xl/worksheets/sheet1.xml")
    out = io.BytesIO()
    xlsx.write_book(out, ["a"], ((i,) for i in range(10)), "D", most_rows=10)
    assert len([n for n in zipfile.ZipFile(out).namelist() if "worksheets" in n]) == 1
