"""Marks and thresholds do not cost a page its article."""

import pytest

from tallyrill.llm import html_text

LINE = "A sentence of the article, with words; and more of them."
P = f"<p>{' '.join([LINE] * 6)}</p>"
SIDE = '<div class="sidebar"><p>Side, text.</p></div>'


@pytest.mark.parametrize("page", [
    '<div class="page">' + f'<div class="elementor-element elementor-widget elementor-widget-text-editor">{P}</div>' * 4 + SIDE + "</div>",
    f'<div class="layout has-sidebar">{P * 4}{SIDE}</div>',
    f'<div class="no-sidebar">{P * 4}</div>{SIDE}',
    f'<article class="post comment-open">{P * 4}</article><ol class="comment-list"><li class="comment"><article class="comment-body">{P * 6}</article></li></ol>',
    f'<article class="post category-promotion">{P * 4}</article>',
    f'<form id="aspnetForm"><div id="c">{P * 4}</div>{SIDE}<div class="footer">Foot, note.</div></form>',
])
def test_marked_containers_of_the_article(page):
    assert html_text.main_text(f"<body>{page}</body>") == "\n".join([" ".join([LINE] * 6)] * 4)


def test_articles_in_articles():
    assert html_text.main_text("<article>" * 3000 + P) == " ".join([LINE] * 6)


ITEMS = "<ul>" + "<li>short</li>" * 10 + "</ul>"
LINKS = '<div><a href="x">Link here</a> <a href="y">Link there</a></div>'


@pytest.mark.parametrize("page", [
    f"<h2>T</h2>{P * 10}{ITEMS}",
    f"<h2>T</h2>{P * 5}{ITEMS}{P * 5}{LINKS}",
    f"<section><h2>T</h2>{P * 4}</section><section>{P * 4}{ITEMS}</section>",
    f"<div><h2>T</h2>{P * 4}{ITEMS}</div>{LINKS}<div><p>{LINE * 9}</p></div>",
])
def test_short_blocks_without_a_container_of_all(page):
    got = html_text.main_text(f"<body>{page}</body>").split("\n")
    assert got.count("short") == 10 and got[0] == "T" and not any("Link" in line for line in got)


TEXT = " ".join([LINE] * 6)


@pytest.mark.parametrize("page", [
    f"<article data-hidden>{P * 3}</article>",
    f'<article data-col2="hidden">{P * 3}</article>',
    f'<article data-x="a" not-hidden=1 aria-hidden="false">{P * 3}</article>',
    f'<div data-x1="not hidden"><article title="hidden or not">{P * 3}</article></div>',
    f"<noscript><article>{P * 3}</article></noscript>",
    f"<article>{P * 3}<noscript>Switch scripts on, please.</noscript><p hidden>{LINE}</p><div HIDDEN=''>{P}</div></article>",
])
def test_hidden_is_a_whole_name(page):
    assert html_text.main_text(f"<body>{page}</body>") == "\n".join([TEXT] * 3)
    assert html_text.main_text(f"<body><article hidden>{P}</article></body>") == ""


@pytest.mark.parametrize("name", ["related-work", "skip", "share", "rail", "overlay", "alert", "notice-board", "plain"])
def test_a_paragraph_of_the_article_outweighs_a_doubtful_class(name):
    last = " ".join([LINE] * 3) + " The end."
    page = f'<article>{P * 3}<div class="{name}"><p>{last}</p></div></article><div class="comments"><p>Reader, says.</p></div>'
    assert html_text.main_text(f"<body>{page}</body>") == "\n".join([*[TEXT] * 3, last])


@pytest.mark.parametrize("name", ["related", "share", "ad", "comments", "newsletter", "sidebar"])
@pytest.mark.parametrize("inner", ["<p>Buy now.</p>", "<p><a href=x>More, of this; and of that, as well.</a></p>", "<ul><li>One thing, or two.</li><li>Another, you know.</li></ul>", "<p>Sign up now, and get our best stories, every week. No spam.</p>"])
def test_short_or_linked_blocks_of_such_a_class_go(name, inner):
    assert html_text.main_text(f'<body><article>{P * 3}<div class="{name}">{inner}</div></article></body>') == "\n".join([TEXT] * 3)
