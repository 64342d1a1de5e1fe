"""Keep-first on streams whose rows come late and out of order, against keep-first of the same rows as a table."""

import random

from pyspark.sql import functions as F

from tallyrill.operators.tabular import keep_first
from tallyrill.streaming import audits, first_rows

SCHEMA = "k string, n int, ts timestamp, v double"


def fed(spark, folder, files):
    """A file for each list of ``k, n, minute, v``, in order."""
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, "k string, n int, minute int, v double").withColumn("ts", F.timestamp_seconds(1_700_000_000 + 60 * F.col("minute"))).select("k", "n", "ts", "v")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/{i:03}")
    return audits.read_folder(spark, f"{folder}/*", df.schema, files_per_trigger=1)


def got(spark, tmp_path, files, **options):
    stream = fed(spark, str(tmp_path / "in"), files)
    with first_rows.rocks(spark):
        out = first_rows.drained(first_rows.first_rows(stream, ["k"], "ts", ["n"], "30 minutes", **options), str(tmp_path / "out"))
    return sorted(map(tuple, out.collect()), key=repr)


def test_late_rows_within_the_watermark(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None, "d e"]), n, rng.randrange(0, 100), n / 2) for n in range(120)]
    rows.sort(key=lambda r: r[2] + rng.randrange(0, 25))  # at most 25 minutes late
    files = [rows[i : i + 20] for i in range(0, 120, 20)] + [[("last", 999, 10_000, 0.0)]]
    plain = spark.createDataFrame([r for f in files[:-1] for r in f], "k string, n int, minute int, v double")
    want = keep_first(plain.withColumn("_o", F.struct("minute", "n")), ["k"], "_o").drop("_o")
    want = want.withColumn("ts", F.timestamp_seconds(1_700_000_000 + 60 * F.col("minute"))).select("k", "n", "ts", "v")
    assert got(spark, tmp_path, files) == sorted(map(tuple, want.collect()), key=repr)


def test_a_key_is_given_out_once_and_waits_for_the_watermark(spark, tmp_path):
    files = [[("a", 2, 50, 1.0), ("a", 1, 50, 2.0), ("w", 1, 9_990, 0.0)], [("b", 1, 10_000, 0.0)], [("a", 0, 40, 3.0), ("a", 5, 20_000, 4.0), ("b", 0, 10_000, 1.0)]]
    found = [(k, n, v) for k, n, _, v in got(spark, tmp_path, files)]
    assert found == [("a", 1, 2.0), ("b", 0, 1.0), ("w", 1, 0.0)]  # the row of minute 40 came after the watermark, that of 20,000 is a copy
