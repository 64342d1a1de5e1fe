"""Channel values of floats against a tolerance, at the tolerance itself."""

import duckdb

import __spark_entry__ as entry
from tallyrill.operators import image_diff


def test_a_difference_of_the_tolerance_is_none(spark):
    for kind, apart in (("float", 1), ("double", 2)):
        df = spark.createDataFrame([(1, [0.0, 0.0, 0.0], [0.3, 0.31, 0.30000001])], f"id long, x array<{kind}>, y array<{kind}>")
        got = image_diff.channel_diff(df, "id", "x", "y", 0.3).first()
        assert (got["different_pixels"], got["total_pixels"]) == (apart, 3)  # 0.30000001 is the float of 0.3


def test_bands_against_sql_at_the_tolerance(spark, tmp_path):
    rows = [(0, [0.0, 0.5]), (1, [0.3, 0.5]), (2, [0.0, 0.9]), (3, [0.3, 0.6])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT vec_id, total_pixels, different_pixels, percent, band FROM ({entry.oracle_sql()['pixel_diff_bands']}) ORDER BY vec_id").fetchall()
    assert list(map(tuple, entry.queries()["pixel_diff_bands"](spark, str(tmp_path)).orderBy("vec_id").collect())) == want
