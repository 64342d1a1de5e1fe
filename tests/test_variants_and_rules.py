"""JSON by shape, and rules on the source of a page."""

import pytest
from pyspark.sql import functions as F

from tallyrill.operators import page_rules, variants

TEXTS = ['{"a": 1, "b": [1, {"c": null}]}', '[{"a": 2}, 3, null, "x"]', '{"@graph": [{"a": true}, {}]}', '{"@graph": {"a": 1}}', "7", '"t"', "[]", "{}", "null", "", "no", '{"a":', None, "[1],[2]"]


def test_records_by_shape(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "id long, j string, SHAPE string")
    got = [(r["id"], r["shape"], r["position"], r["t"]) for r in variants.records(df, "j", ["id"]).select("id", "shape", "position", F.to_json("record").alias("t")).orderBy("id", "position").collect()]
    assert got == [
        (0, "object", 0, '{"a":1,"b":[1,{"c":null}]}'), (1, "list", 0, '{"a":2}'), (1, "list", 1, "3"), (1, "list", 2, "null"), (1, "list", 3, '"x"'),
        (2, "graph", 0, '{"a":true}'), (2, "graph", 1, "{}"), (3, "object", 0, '{"@graph":{"a":1}}'), (4, "scalar", 0, "7"), (5, "scalar", 0, '"t"'), (7, "object", 0, "{}"), (8, "scalar", 0, "null"),
    ]
    found = variants.fields(variants.records(df, "j", ["id"]), ["id", "position"])
    assert sorted(map(tuple, found.collect())) == [(0, 0, "a", "BIGINT", "1"), (0, 0, "b", "ARRAY<VARIANT>", '[1,{"c":null}]'), (1, 0, "a", "BIGINT", "2"), (2, 0, "a", "BOOLEAN", "true"), (3, 0, "@graph", "OBJECT<a: BIGINT>", '{"a":1}')]
    by = {r["shape"]: (r["n_texts"], r["merged_type"]) for r in variants.shapes(df, "j").collect()}
    assert {s: n for s, (n, _) in by.items()} == {"object": 3, "list": 2, "graph": 1, "scalar": 3, "none": 5}
    assert by["graph"][1] == "OBJECT<`@graph`: ARRAY<OBJECT<a: BOOLEAN>>>" and variants.records(df.limit(0), "j", ["id"]).count() == 0


HEAD = '<html lang="en"><title>T</title><main>'


@pytest.mark.parametrize(("page", "want"), [
    (HEAD + "<h1>a</h1><h2>b</h2><h1>c</h1><h3>d</h3></main>", [("heading-order", "h3[1]")]),
    (HEAD + "<h2>a</h2></main>", [("heading-order", "h2[1]")]),
    ("<p>x", [("document-title", None), ("html-has-lang", None), ("landmark-one-main", None)]),
    ('<html lang=""><title> </title><main></main>', [("document-title", None), ("html-has-lang", None)]),
    (HEAD + "<img><img alt><img alt=''><img data-alt='x'><img aria-label=n></main>", [("image-alt", "img[1]"), ("image-alt", "img[4]")]),
    (HEAD + "<!-- <img> --><script>'<img>'</script><template><img></template></main>", []),
    (HEAD + "<input><input type=submit><input aria-label=x><label for=a>A</label><input id=a><label>b<textarea></textarea></label><select></select></main>", [("label", "input[1]"), ("label", "select[1]")]),
    (HEAD + "<a href=x></a><a href=x>t</a><a>no</a><a href=x><b>deep</b></a><a href=x title=t></a><a href=x><img alt='i'></a><a href=x><img alt=''></a> after</main>", [("link-name", "a[1]"), ("link-name", "a[7]")]),
    (HEAD + "<button></button>x<button><i>t</i></button><button aria-label=n></button></main>", [("button-name", "button[1]")]),
    (HEAD + '<p id="x"></p><p id=y></p><b id=\'x\'></b><i id></i><i id></i></main>', [("duplicate-id", "b[1]")]),
    (HEAD + '<p title="a > <img>">x</p></main>', []),
    (None, []),
    ("", []),
])
def test_rules(spark, page, want):
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    got = page_rules.findings(df).collect()
    assert sorted((r["rule"], r["node"]) for r in got) == sorted(want)
    assert all(r["impact"] == page_rules.RULES[r["rule"]] for r in got)


def test_pages_are_dealt_by_their_size(spark, monkeypatch):
    """What a task sorts is bounded by bytes of pages, not by a share of the table."""
    monkeypatch.setattr(page_rules, "PART", 1000)
    df = spark.createDataFrame([(i, HEAD + "<img>" + "x" * 400 + "</main>") for i in range(100)], "page_id long, html string")
    got = page_rules.findings(df)
    assert got.rdd.getNumPartitions() >= 40 and {tuple(r) for r in got.collect()} == {(i, "image-alt", "critical", "img[1]") for i in range(100)}
