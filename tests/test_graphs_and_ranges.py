"""Redirects, intervals and mergeable profiles against plain definitions."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tallyrill.functions.urls import resolved
from tallyrill.operators import profiles, ranges, redirects

BASES = ["http://h.example/a/b/c?q=1#f", "https://h.example", "http://h.example/", "http://h.example/a/", "http://u@h.example:80/x/y/../z"]
LINKS = ["", "g", "./g", "g/", "/g", "//other.example", "//other.example/p/../q", "?y", "g?y", "#s", "g#s", "g?y#s", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", "..g", "./../g", "./g/.", "g/./h", "g/../h", "/a/./b/../c", "https://x.example/a/../b", "mailto:a@b.example", "g;x=1/../y", "ü/漢"]


def test_links_are_resolved_as_the_library_does(spark):
    pairs = [(b, t) for b in BASES for t in LINKS]
    df = spark.createDataFrame([*pairs, (None, "a"), ("http://h.example/", None)], "base string, target string")
    got = {(r["base"], r["target"]): r["url"] for r in df.select("base", "target", resolved(F.col("base"), F.col("target")).alias("url")).collect()}
    assert got.pop((None, "a")) is None and got.pop(("http://h.example/", None)) is None
    with_host = {"//other.example/p/../q": "//other.example/q", "https://x.example/a/../b": "https://x.example/b"}  # the library keeps their dots
    odd = {}
    for b, t in pairs:
        want = (b.split(":")[0] + ":" if t.startswith("/") else "") + with_host[t] if t in with_host else urljoin(b, t)
        if got[b, t] != want:
            odd[b, t] = (got[b, t], want)
    assert not odd, list(odd.items())[:4]


def walked(moves, url, hops):
    at, n = moves[url], 1
    while at in moves and n <= len(moves) + 1:
        at, n = moves[at], n + 1
    if at in moves:
        return None, None, "cycle"
    return (at, n, "ok") if n <= hops else (None, n, "too many")


@pytest.mark.parametrize("seed", range(3))
def test_random_redirects(spark, seed):
    rng = random.Random(seed)
    moves = {f"http://h/{i}": f"http://h/{rng.randrange(90)}" for i in range(60)}
    moves |= {f"http://c/{i}": f"http://c/{i + 1}" for i in range(40)} | {"http://self/": "http://self/"}
    rows = [(u, t.removeprefix("http://h") if u.startswith("http://h") else t) for u, t in moves.items()]
    df = spark.createDataFrame([*rows, rows[0], (None, "x"), ("http://none/", None)], "url string, location string")
    got = {r["url"]: (r["final_url"], r["n_hops"], r["verdict"]) for r in redirects.followed(df, hops=10).collect()}
    assert got == {u: walked(moves, u, 10) for u in moves}
    short = {r["url"]: r["verdict"] for r in redirects.followed(df, hops=10, cycles=False).collect()}
    assert short == {u: "ok" if v[2] == "ok" else "too many" for u, v in got.items()}


def test_redirect_edge_cases(spark):
    empty = spark.createDataFrame([], "url string, location string")
    assert redirects.followed(empty).count() == 0
    two = spark.createDataFrame([("http://a/", "http://z/"), ("http://a/", "http://b/")], "url string, location string")
    assert [tuple(r) for r in redirects.followed(two).collect()] == [("http://a/", "http://b/", 1, "ok")]


def looked_up(spark, points, intervals):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "id long, k long")
    table = spark.createDataFrame(intervals, "ord int, low long, high long, name string")
    return rows, table, ranges.range_lookup(rows, "k", table, "low", "high", "ord", ["name"])


@pytest.mark.parametrize("per_bucket, per_part", [(4096, 10**6), (7, 20)])
def test_first_interval_wins(spark, monkeypatch, per_bucket, per_part):
    monkeypatch.setattr(ranges, "INTERVALS", per_bucket)
    monkeypatch.setattr(ranges, "ROWS", per_part)
    rng = random.Random(per_bucket)
    intervals = [(rng.randrange(40), low, low + rng.choice([-1, 0, 1, 5, 40, 900]), f"n{i}") for i, low in enumerate(rng.randrange(-500, 500) for _ in range(150))]
    intervals += [(0, None, 3, "x"), (0, 3, None, "y")]
    points = [rng.randrange(-600, 1600) for _ in range(300)] + [7] * 150 + [None]
    _, _, df = looked_up(spark, points, intervals)
    got = {r["id"]: (r["k"], r["name"]) for r in df.collect()}
    assert len(got) == len(points) and df.columns == ["id", "k", "name"]
    for i, p in enumerate(points):
        fit = [(o, n) for o, a, b, n in intervals if None not in (a, b, p) and a <= p <= b]
        least = min((o for o, _ in fit), default=None)
        assert got[i][0] == p and got[i][1] in ({n for o, n in fit if o == least} or {None})


def test_no_nested_loop_and_edge_cases(spark):
    _, _, df = looked_up(spark, [1, 5], [(1, 1, 3, "a")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Broadcast" not in plan
    assert sorted(map(tuple, df.collect())) == [(0, 1, "a"), (1, 5, None)]
    assert looked_up(spark, [], [(1, 1, 3, "a")])[2].count() == 0
    assert [r["name"] for r in looked_up(spark, [1], [])[2].collect()] == [None]
    rows, table, _ = looked_up(spark, [1], [(1, 1, 3, "a")])
    with pytest.raises(ValueError):
        ranges.range_lookup(rows.withColumnRenamed("id", "NAME"), "k", table, "low", "high", "ord", ["name"])


def test_profiles_of_parts_add_up(spark):
    n = 40_000
    df = spark.range(n).select((F.col("id") % 7).alias("part"), F.concat(F.lit("v"), F.col("id") % 9000).alias("a"), F.when(F.col("id") % 10 != 0, F.col("id")).alias("b"), F.lit(None).cast("string").alias("c"))
    stored = profiles.profiles(df, F.col("part"), ["a", "b", "c"])
    whole = profiles.merged(profiles.profiles(df, F.lit("all"), ["a", "b", "c"]))
    parts = profiles.estimates(profiles.merged(stored))
    one, other = ({r["column_name"]: r.asDict() for r in x.collect()} for x in (parts, profiles.estimates(whole)))
    exact = {"a": 9000, "b": 36_001, "c": 1}
    for c in exact:
        assert one[c]["distinct_values"] == other[c]["distinct_values"]  # the same registers
        assert abs(one[c]["distinct_values"] - exact[c]) <= profiles.error() * exact[c]
        assert [one[c][k] for k in ("total_rows", "blanks", "least", "most")] == [other[c][k] for k in ("total_rows", "blanks", "least", "most")]
    assert (one["b"]["blanks"], one["c"]["blanks"], one["a"]["total_rows"], one["a"]["least"]) == (4000, n, n, "v0")
    halves = profiles.merged(profiles.merged(stored.where("part < 3")).select("*").union(profiles.merged(stored.where("part >= 3"))))
    assert {r["column_name"]: r["distinct_values"] for r in profiles.estimates(halves).collect()} == {c: one[c]["distinct_values"] for c in exact}
    assert profiles.merged(stored.limit(0)).count() == 0


def test_values_that_parts_share(spark):
    df = spark.range(20_000).select(F.explode(F.array(F.lit("x"), F.lit("y"))).alias("part"), "id").select("part", F.when(F.col("part") == "x", F.col("id")).otherwise(F.col("id") + 15_000).alias("v"))
    got = profiles.shared_values(profiles.profiles(df, F.col("part"), ["v"]), "x", "y").first()
    assert abs(got["shared_values"] - 5000) < 600
