import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyrill import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr) == want


def test_every_sql_has_a_query_and_the_flagship_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1


def test_streams(spark, tmp_path):
    from tallyrill.streaming import audits

    df = spark.createDataFrame([(1, "Ã©", "x1"), (2, "ok", "1000"), (2, "ok", "1000")], "_ord long, a string, postal_code string").selectExpr("*", "timestamp'2024-01-01 00:00:00' AS ts")
    df.write.parquet(str(tmp_path / "in"))
    stream = audits.read_folder(spark, str(tmp_path / "in"), df.schema)
    for name, out in {"f": audits.findings(stream, "_ord", ["a"]), "p": audits.invalid_postals(stream, "_ord"), "k": audits.keep_first(stream, ["_ord"], "ts")}.items():
        q = out.writeStream.format("memory").queryName(f"s_{name}").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("s_f").count() == 1 and spark.table("s_p").count() == 1 and spark.table("s_k").count() == 2
