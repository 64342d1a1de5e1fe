"""The tag-path ratio decides what is content; what elements say they are only weighs it."""

import os

import pytest

from tallyrill.llm import html_text

LINE = "A sentence of the article, with words; and more of them."
P = f"<p>{' '.join([LINE] * 4)}</p>"
TEXT = " ".join([LINE] * 4)
NAV = "<div><ul>" + "".join(f'<li><a href="/{i}">Entry {i}</a></li>' for i in range(8)) + "</ul></div>"
SF = "/root/testdata/sf0.001/pages.parquet"


def constant(monkeypatch):
    real = html_text.ratios

    def same(blocks, texts):
        paths, mean, _ = real(blocks, texts)
        return paths, dict.fromkeys(mean, 100.0), 0.0

    monkeypatch.setattr(html_text, "ratios", same)


def test_a_constant_ratio_gives_another_and_worse_text(monkeypatch):
    page = f"<body>{NAV}<div class='ad'>Buy now.</div><div><h2>Title</h2>{P * 3}</div><div>Imprint</div></body>"
    want = "\n".join(["Title", *[TEXT] * 3])
    assert html_text.main_text(page) == want
    constant(monkeypatch)
    got = html_text.main_text(page)
    assert got != want and "Entry 3" in got and "Buy now" in got


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_pages_without_classes_keep_their_text(monkeypatch):
    import pyarrow.parquet as pq

    pages = pq.read_table(SF)["html"].to_pylist()
    texts = [html_text.main_text(p) for p in pages]
    assert all(texts) and [html_text.main_text(p.replace(' class="ad"', "")) for p in pages] == texts
    neutral = [p.replace(' class="ad"', "").replace("<article", "<div").replace("</article", "</div").replace("<nav", "<div").replace("</nav", "</div").replace("<footer", "<div").replace("</footer", "</div") for p in pages]
    assert sum(html_text.main_text(p) == t for p, t in zip(neutral, texts, strict=True)) >= 0.7 * len(pages)
    constant(monkeypatch)
    assert sum(html_text.main_text(p) == t for p, t in zip(pages, texts, strict=True)) == 0


@pytest.mark.parametrize("page", [
    f'<article class="post no-sidebar">{P * 3}</article><div class="comments">{P * 6}</div>',
    f'<main class="has-sidebar">{P * 3}</main><aside>{P * 3}</aside>',
    f'<article id="comment-on-budget">{P * 3}</article><footer>{P}</footer>',
    f'<div class="content-with-menu"><article>{P * 3}</article></div>',
    f'<article class="post-teaser-hero">{P * 3}</article>',
    f'<form id="aspnetForm"><div class="x">{P * 3}</div><div class="footer">Foot, note.</div></form>',
])
def test_a_mark_on_the_article_does_not_cost_it(page):
    assert html_text.main_text(f"<body>{page}</body>") == "\n".join([TEXT] * 3)


@pytest.mark.parametrize("page", [
    "<nav><a href='/'>Home</a></nav><footer>Imprint, and contact.</footer>",
    "<div class='cookie-notice'>We use cookies, you know.</div>",
    "<header><h1>Site</h1></header><form><p>Your mail, please.</p></form>",
])
def test_pages_without_an_article_have_no_text(page):
    assert html_text.main_text(f"<body>{page}</body>") == ""


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, P, "x", 3), (1, P, "x", 3), (2, None, None, None)], "page_id long, html string, Text string, N_CHARS int")
    got = html_text.extract(df).orderBy("page_id").collect()
    assert html_text.extract(df).columns == ["page_id", "html", "text", "n_chars"]
    assert [r["text"] for r in got] == [TEXT, TEXT, ""] and html_text.extract(df.limit(0)).count() == 0
