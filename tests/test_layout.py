"""Laid-out text: block borders, line breaks, preserved white space, what is not shown."""

import pytest

from tallyrill.functions.layout import laid_out, laid_out_text


@pytest.mark.parametrize(("page", "want"), [
    (None, ""),
    ("", ""),
    ("plain  \n text", "plain text"),
    ("<p>one</p><p>two</p>", "one\n\ntwo"),
    ("<div>one</div><div>two</div>three<section>four</section>", "one\ntwo\nthree\nfour"),
    ("<div><div><p>a</p></div></div><div>b</div>", "a\n\nb"),
    ("a<br>b<br><br>c <br> d", "a\nb\n\nc\nd"),
    ("<b>in</b>line <i> text </i> more", "inline text more"),
    ("<ul> <li>x</li>\n<li>y <ul><li>z</li></ul></li></ul>", "x\ny\nz"),
    ("<pre>a  b\n  c</pre>after  that", "a  b\n  c\nafter that"),
    ("<table><tr><td>1</td><td>2</td></tr><tr><th>3</th> <td>4</td></tr></table>", "1\t2\n3\t4"),
    ("<head><title>T</title></head><body>b<script>x<y</script><style>s</style><p hidden>h</p><p style='display: none'>n<b>m</b></p>e</body>", "be"),
    ("x &amp; y&nbsp;z &lt;p&gt;", "x & y\xa0z <p>"),
    ("<div>open <p>never <b>closed", "open\n\nnever closed"),
    ("</div>stray</p> end", "stray end"),
    ("<!-- no --> text <!-- at all -->", "text"),
    ("<p>a</p>   <p>   </p>  <p>b</p>", "a\n\nb"),
    ("<textarea> k </textarea>", "k"),
    ("<div>" * 3000 + "deep", "deep"),
])
def test_layout(page, want):
    assert laid_out_text(page) == want


def test_as_a_column(spark):
    df = spark.createDataFrame([(1, "<p>a</p>b"), (2, None), (3, "")], "id long, html string")
    assert [r[0] for r in df.orderBy("id").select(laid_out("html")).collect()] == ["a\n\nb", "", ""]


def test_references_that_end(spark):
    cases = {"<p>a &amp;&amp</p>b": "a &&amp\n\nb", "&lt;&ltx &notit; &#65;&#65 &#x42; &": "<&ltx &notit; A&#65 B &", "<p title='&amp'>x&copy;</p>": "x©"}
    assert {page: laid_out_text(page, closed=True) for page in cases} == cases
    assert laid_out_text("&amp</p>") == "&"


def test_layout_query_on_a_title_cut_within_a_reference(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    pages = ["<html><head><title>t</title></head><body><h1>a &amp;&amp;&amp</h1><article><p>b &amp c</p></article></body></html>", "<html><body><p>x &lt y &copy; z</p></body></html>", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["page_layout_text"]).fetchall())
    assert sorted(map(tuple, entry.queries()["page_layout_text"](spark, str(tmp_path)).collect())) == want
