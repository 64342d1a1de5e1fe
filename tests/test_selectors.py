"""Selectors against a definition by trial of all nodes, on random trees; the table function in SQL."""

import random

import pytest
from pyspark.errors import AnalysisException

from tallyrill.functions.selectors import compiled, elements
from tallyrill.operators import web

TAGS, CLASSES = ["div", "p", "a", "ul", "li"], ["x", "y", "x y", ""]


def random_tree(rng):
    root = web.Node("#root", {}, None)
    nodes = [root]
    for i in range(rng.randrange(1, 26)):
        up = rng.choice(nodes[-6:])
        if rng.random() < 0.3:
            up.children.append("text")
        attrs = {"class": rng.choice(CLASSES), "id": f"n{i}", **({"href": rng.choice(["/a", "/b-c", "http://x"])} if rng.random() < 0.5 else {}), **({"lang": rng.choice(["en", "en-gb", "fr en"])} if rng.random() < 0.4 else {})}
        node = web.Node(rng.choice(TAGS), attrs, up)
        up.children.append(node)
        nodes.append(node)
    return root


SIMPLE = {
    "div": lambda n: n.tag == "div",
    "*": lambda n: True,
    "li.x": lambda n: n.tag == "li" and "x" in n.attrs["class"].split(),
    ".x.y": lambda n: {"x", "y"} <= set(n.attrs["class"].split()),
    "#n3": lambda n: n.attrs["id"] == "n3",
    "[href]": lambda n: "href" in n.attrs,
    '[href^="/"]': lambda n: n.attrs.get("href", "").startswith("/"),
    "a[href$='c']": lambda n: n.tag == "a" and n.attrs.get("href", "").endswith("c"),
    "[href*=tp]": lambda n: "tp" in n.attrs.get("href", ""),
    "[lang~=en]": lambda n: "en" in n.attrs.get("lang", "").split(),
    "[lang|=en]": lambda n: n.attrs.get("lang") in ("en", "en-gb"),
    "[lang=en]": lambda n: n.attrs.get("lang") == "en",
    ":first-child": lambda n: order(n)[0] == 1,
    "p:last-child": lambda n: n.tag == "p" and order(n)[1] == 1,
    ":only-child": lambda n: order(n) == (1, 1),
    ":nth-child(odd)": lambda n: order(n)[0] % 2 == 1,
    ":nth-child(3n - 1)": lambda n: order(n)[0] in range(2, 99, 3),
    ":nth-child(-n+2)": lambda n: order(n)[0] <= 2,
    ":nth-last-child(2)": lambda n: order(n)[1] == 2,
    ":not(.x)": lambda n: "x" not in n.attrs["class"].split(),
    "li:not(:first-child)": lambda n: n.tag == "li" and order(n)[0] != 1,
}


def order(n):
    among = [c for c in n.parent.children if not isinstance(c, str)]
    at = [c is n for c in among].index(True)
    return at + 1, len(among) - at


def related(relation, before, n):
    """Whether ``before`` stands to ``n`` as the relation says."""
    if relation == ">":
        return n.parent is before
    if relation == " ":
        up = n.parent
        while up is not None and up is not before:
            up = up.parent
        return up is before
    among = [c for c in n.parent.children if not isinstance(c, str)]
    if before.parent is not n.parent:
        return False
    gap = [c is n for c in among].index(True) - [c is before for c in among].index(True)
    return gap == 1 if relation == "+" else gap > 0


def brute(nodes, steps, relations):
    """All nodes that end a chain of nodes, one for each step."""
    found = [n for n in nodes if SIMPLE[steps[0]](n)]
    for step, relation in zip(steps[1:], relations, strict=True):
        found = [n for n in nodes if SIMPLE[step](n) and any(related(relation, b, n) for b in found)]
    return {id(n) for n in found}


def test_random_selectors_on_random_trees():
    rng = random.Random(5)
    hits = 0
    for _ in range(200):
        root = random_tree(rng)
        nodes = [*root.below()]
        for _ in range(8):
            ways = []
            for _ in range(rng.choice([1, 1, 2])):
                steps = [rng.choice([*SIMPLE]) for _ in range(rng.randrange(1, 5))]
                ways.append((steps, [rng.choice(" >+~") for _ in steps[1:]]))
            text = rng.choice([", ", ",", " , "]).join(steps[0] + "".join((r if r == " " else rng.choice([r, f" {r} "])) + s for s, r in zip(steps[1:], relations, strict=True)) for steps, relations in ways)
            want = set().union(*(brute(nodes, *w) for w in ways))
            assert {id(n) for n in nodes if compiled(text)(n)} == want, text
            hits += len(want)
    assert hits > 1000


@pytest.mark.parametrize("text", ["", " ", ">", "a >", "a,,b", "a[", "a[b", ":hover", "a:nth-child()", "a:nth-child(x)", ":not(a b)", "a b,", "a!b", "[a=b c]"])
def test_what_is_no_selector_is_refused(text):
    with pytest.raises(ValueError):
        compiled(text)


def test_deep_pages():
    node = web.tree("<div>" * 5000 + "<p>deep</p>")
    assert [n.text() for n in node.below() if compiled("div div div > p")(n)] == ["deep"] and node.text() == "deep"
    assert len(elements(node)) == 1


PAGE = '<ul id="m"><li>one <a href="/1">A</a></li><li><a>B</a></li><li>three</li></ul>'


def test_columns_follow_the_field_map(spark):
    web.register(spark)
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<li>x")], "id long, html string")
    got = spark.sql("SELECT p.id, r.* FROM {p} AS p, LATERAL select_records(html, 'li', map('name', 'a', 'link', 'a[href]')) AS r", p=pages)
    assert got.columns == ["id", "position", "name", "link"]
    assert sorted(map(tuple, got.collect())) == [(1, 0, "A", "A"), (1, 1, "B", ""), (1, 2, "", ""), (4, 0, "", "")]
    plain = spark.sql("SELECT p.id, r.text FROM {p} AS p, LATERAL select_records(html, '#m > li:last-child') AS r", p=pages)
    assert sorted(map(tuple, plain.collect())) == [(1, "three")]
    assert [tuple(r) for r in web.select_records(pages, "ul > li:nth-child(2)", {"b": "a"}, "id").collect()] == [(1, 0, "B")]


@pytest.mark.parametrize("call", ["select_records(html, html)", "select_records(html, 'a:hover')", "select_records(html, 'a', map('x', html))"])
def test_calls_that_cannot_be_analysed(spark, call):
    web.register(spark)
    pages = spark.createDataFrame([(1, PAGE)], "id long, html string")
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM {{p}} AS p, LATERAL {call} AS r", p=pages).collect()
