from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyrill.functions import address, html, text, urls


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names)).select(column).first()[0]


def test_strip_is_unicode_aware(spark):
    rows = [" a b\t\n", "  x", "", " "]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "c string").select(text.strip(F.col("c"))).collect()]
    assert got == [r.strip() for r in rows]


def test_title_and_percent(spark):
    words = ["o'neil's", "foo-bar", "a1b", "tab\tbed", "", None]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "c string").select(text.title_case("c")).collect()]
    assert got == [w.title() if w is not None else None for w in words]
    values = [i / 20 for i in range(2000)] + [12345.6]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(text.pct_text(F.col("x"))).collect()]
    assert got == [f"{v:.1f}%" for v in values]


def test_similarity_matches_difflib_and_depends_on_order(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("A ", "a"), ("x" * 250, "x" * 249 + "y"), (None, "a")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(text.seq_ratio("a", "b")).collect()]
    want = [SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio() if a and b else 0.0 for a, b in pairs]
    assert got == want and got[0] != got[1]


def test_detectors_and_na_tokens(spark):
    cells = ["Ã©", "ok??", "�", "<b>", "AT&amp;T", "&AMP;", "Ã©<b>", "plain"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(text.finding(F.col("c"))).collect()]
    m, h = text.MOJIBAKE_TYPE, text.HTML_TYPE
    assert got == [m, m, m, h, h, None, m, None]
    assert [r[0] for r in spark.createDataFrame([("NA",), ("null",), ("-",)], "c string").select(text.na_to_null(F.col("c"))).collect()] == [None, None, "-"]


@pytest.mark.parametrize(("spec", "want"), [("1,3-5", [0, 2, 3, 4]), ("5-3", []), ("9-20", [8, 9]), ("2,2, 2", [1]), ("", list(range(10))), ("x", []), ("0", [])])
def test_page_ranges(spark, spec, want):
    assert one(spark, text.page_ranges(F.col("c"), F.lit(10)), c=spec) == want


def test_paths_texts_and_uri(spark):
    assert one(spark, text.stem(F.col("c")), c="/a/b.tar.gz") == "b.tar"
    assert one(spark, text.uri_component(F.col("c")), c="a b&c!'()~*é+") == "a%20b%26c!'()~*%C3%A9%2B"
    assert one(spark, text.text_or(F.col("c"), "(no title)"), c=" \n") == "(no title)"
    assert text.field_map("name:h3, phone:.tel:x,bad") == {"name": "h3", "phone": ".tel"}
    assert text.column_list(" a, ,b ") == ["a", "b"]


def test_postal_and_province(spark):
    cases = {"1000": ("Brussels-Capital Region", True), "0999": ("", True), "9999": ("East Flanders", True), "1-000": ("Brussels-Capital Region", False), "B-1000": ("Brussels-Capital Region", False), "1234 AB": ("Brussels-Capital Region", False), "": ("", False), None: ("", False), " 5000 ": ("Namur", True)}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    got = df.select(address.province_be(F.col("c")), address.postal_valid(F.col("c"), F.lit("be"))).collect()
    assert [tuple(r) for r in got] == list(cases.values())
    others = [("1234 ab", "NL", True), ("SW1A 1AA", "GB", True), ("12345-6789", "US", True), ("123", "DE", False), ("x", "XX", True)]
    got = spark.createDataFrame([o[:2] for o in others], "c string, cc string").select(address.postal_valid(F.col("c"), F.col("cc"))).collect()
    assert [r[0] for r in got] == [o[2] for o in others]


def test_address(spark):
    rows = [(", Main 1 ,", "1000", "Brussels", "P", "Main 1, 1000 Brussels, P, Belgium"), (None, "", "Ghent", None, "Ghent, Belgium"), ("", "9000", None, "", "9000, Belgium"), (None, None, None, None, "Belgium")]
    df = spark.createDataFrame([r[:4] for r in rows], "s string, c string, t string, p string")
    got = df.select(address.format_address(F.col("s"), F.col("c"), F.col("t"), F.col("p"))).collect()
    assert [r[0] for r in got] == [r[4] for r in rows]


def test_url_domain(spark):
    cases = {"example.com/x": "example.com", "http://a.b:80/x": "a.b:80", "https://u@h/": "u@h", "HTTP://Up.com/": "HTTP:", "http://foo bar": "foo bar", "  ": None, None: None, "https://h?q": "h", "http:///p/q": ""}
    got = spark.createDataFrame([(k,) for k in cases], "c string").select(urls.url_domain(F.col("c"))).collect()
    assert [r[0] for r in got] == list(cases.values())
    got = spark.createDataFrame([("http://a/b/c", "../d"), (None, "x")], "b string, t string").select(urls.resolve("b", "t")).collect()
    assert [r[0] for r in got] == ["http://a/d", None]


def test_markdown_quirks_and_script_safety(spark):
    page = "<h2>T</h2><pre>code</pre>" + "<script>" + "<" * 3000 + "</script><h1>a\nb</h1><p>x &amp;lt; y</p><ul><li>one</li></ul>"
    got = one(spark, html.html_to_markdown(F.col("c")), c=page)
    assert got == "## T\n\ncodea\n\nb\n\nx < y\n\n- one"


def test_jsonld(spark):
    tag = lambda b: f"<script type='application/ld+json'>{b}</script>"
    page = "".join(map(tag, ['{"a":1}', "[1,{\"b\":2}]", '{"@graph":[{"c":3}]}', "{bad", "null"]))
    assert one(spark, html.jsonld_records(F.col("c")), c=page) == ['{"a":1}', "1", '{"b":2}', '{"c":3}']
    blocks = one(spark, html.jsonld_blocks(F.col("c")), c=page)
    assert [b["error"] for b in blocks] == [None, None, None, "Invalid JSON", None] and blocks[3]["raw"] == "{bad"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=20))
def test_norm_is_idempotent(spark, cells):
    df = spark.createDataFrame([(c,) for c in cells], "c string").select(text.strip(F.col("c")).alias("c"))
    assert df.where(text.strip(F.col("c")) != F.col("c")).count() == 0
