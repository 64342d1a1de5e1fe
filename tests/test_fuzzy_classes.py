"""Fuzzy pairs between classes of equal names: nothing is lost, and their number does not grow with copies."""

import __spark_entry__ as entry
from tallyrill.operators import entity

NAMES = ["Blue ring", " blue ring", "blue rings", "old plate", "old plates", None, "BLUE RING ", "", "blue thing", "old plate"]


def table(spark, copies):
    rows = [(i + k * len(NAMES), t, ["x", "y", None][i // 4 % 3] if i < 9 else "y") for k in range(copies) for i, t in enumerate(NAMES)]
    return spark.createDataFrame(rows, "ord long, name string, block string")


def pairs_of(links, members):
    a, b = members.alias("a"), members.alias("b")
    on = lambda side, i: (links["block"] == side("block")) & (links[f"class_{i}"] == side("class"))
    from pyspark.sql import functions as F

    got = links.join(a, on(lambda c: F.col(f"a.{c}"), 1)).join(b, on(lambda c: F.col(f"b.{c}"), 2) & (F.col("a.ord") < F.col("b.ord")))
    return sorted((r[0], r[1], r[2], r[3]) for r in got.select(F.col("a.ord"), F.col("b.ord"), links["block"], "similarity").collect())


def test_links_and_members_are_the_pairs(spark):
    for block in ("block", None):
        for copies in (1, 3):
            df = table(spark, copies)
            links, members = entity.fuzzy_links(df, "name", block, "ord", 0.7), entity.fuzzy_members(df, "name", block, "ord")
            want = sorted((r["ord_1"], r["ord_2"], r["block"], r["similarity"]) for r in entity.fuzzy_pairs(df, "name", block, "ord", 0.7).collect())
            assert pairs_of(links, members) == want and want
            sizes = {(r["block"], r["class"]): r["count"] for r in members.groupBy("block", "class").count().collect()}
            assert all(sizes[r["block"], r[f"class_{i}"]] == r[f"members_{i}"] for r in links.collect() for i in (1, 2))
            key = lambda r: (r["block"], r["ord_1"], r["ord_2"])
            every = sorted(entity.fuzzy_pairs(df, "name", block, "ord", 0.7).collect(), key=key)
            for n in (1, 4, 100):
                assert entity.first_fuzzy_pairs(df, "name", block, "ord", n, 0.7).collect() == every[:n]


def test_the_query_does_not_grow_with_copies(spark, tmp_path):
    sizes = []
    for copies in (2, 6):
        folder = tmp_path / str(copies)
        table(spark, copies).selectExpr("ord AS p_partkey", "name AS p_name", "block AS p_brand").write.parquet(f"{folder}/part.parquet")
        sizes.append(entry.queries()["fuzzy_pairs"](spark, str(folder)).count())
    assert sizes[0] == sizes[1] > 0
