"""Web pages by pattern, on the JVM: markdown, headings, links, JSON-LD, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrill.functions.text import strip
from tallyrill.functions.urls import resolved

#: The script content ends at the first end tag: no nested quantifiers, which overflow the matcher's stack.
SCRIPT, STYLE = r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>"
JSONLD = r"(?is)<script\b[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def _chain(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


# The patterns that make markdown, in order, and the entities decoded after them, in order.
MARKDOWN = [
    (SCRIPT, ""),
    (STYLE, ""),
    (r"(?i)<h1[^>]*>(.*?)</h1>", "\n# $1\n"),
    (r"(?i)<h2[^>]*>(.*?)</h2>", "\n## $1\n"),
    (r"(?i)<h3[^>]*>(.*?)</h3>", "\n### $1\n"),
    (r"(?i)<p[^>]*>(.*?)</p>", "\n$1\n"),
    (r"(?i)<li[^>]*>(.*?)</li>", "- $1\n"),
    (r"<[^>]+>", ""),
]
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]


def html_to_markdown(html: Column) -> Column:
    """Headings 1 to 3, paragraphs and list items as lines; other tags go, five entities are decoded in order."""
    body = _chain(html, MARKDOWN)
    for entity, to in ENTITIES:
        body = F.replace(body, F.lit(entity), F.lit(to))
    lines = F.filter(F.transform(F.split(body, "\n"), strip), lambda x: x != "")
    return F.array_join(lines, "\n\n")


def plain(html: Column) -> Column:
    """Tags removed, stripped."""
    return strip(F.regexp_replace(html, r"<[^>]+>", ""))


def body_text(html: Column) -> Column:
    """The text of a page's source, tags, scripts and styles removed; what a browser lays out may differ."""
    body = F.regexp_replace(html, r"(?is)<head\b.*?</head>", "")
    return strip(F.regexp_replace(_chain(body, [(SCRIPT, ""), (STYLE, ""), (r"<[^>]+>", " ")]), r"[ \t]+", " "))


def title(html: Column) -> Column:
    return strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def headings(html: Column, deepest: int = 6, most: int = 100) -> Column:
    """``array<struct<tag, text>>`` of h1 to ``h<deepest>``, texts cut to ``most``."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<h[1-{deepest}]\b[^>]*>.*?</h[1-{deepest}]>"), F.lit(0))
    return F.transform(found, lambda h: F.struct(F.lower(F.substring(h, 2, 2)).alias("tag"), F.substring(plain(h), 1, most).alias("text")))


def indented(tag: Column, text: Column) -> Column:
    """A heading's line in an outline."""
    level = F.substring(tag, 2, 1).cast("int")
    return F.concat(F.repeat(F.lit("  "), level - 1), tag, F.lit(": "), text)


#: An attribute's value: quoted, or bare up to a space or the tag's end.
_HREF = r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def links(html: Column, most: int = 50) -> Column:
    """``array<struct<text, href>>`` of anchors with a link, quoted or not, texts cut to ``most``; ``href`` is as the page has it."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<a\b[^>]*?{_HREF}[^>]*>.*?</a>"), F.lit(0))
    part = lambda a, i: F.regexp_extract(a, rf"(?is)^<a\b[^>]*?{_HREF}", i)
    return F.transform(found, lambda a: F.struct(F.substring(plain(a), 1, most).alias("text"), F.concat(part(a, 1), part(a, 2), part(a, 3)).alias("href")))


def base_of(html: Column, url: Column) -> Column:
    """What a page's links are relative to: its ``base`` element's address, itself resolved, else the page's own."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<base\b[^>]*?{_HREF}"), F.lit(0))
    value = F.regexp_replace(F.get(found, F.lit(0)), r"(?is)^.*?\bhref\s*=\s*[\"']?|[\"']$", "")
    return F.coalesce(F.when(value != "", resolved(url, value)), url)


def jsonld_texts(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(JSONLD), F.lit(1)), strip)


def is_json(t: Column) -> Column:
    """Whether the whole text is one JSON value; parsers stop at the end of the first."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1, F.lit(False))


def jsonld_blocks(html: Column) -> Column:
    """``array<struct<json, raw, error>>``: valid blocks as JSON text, others raw with an error."""
    def block(t: Column) -> Column:
        valid = is_json(t)
        return F.struct(F.when(valid, t).alias("json"), F.when(~valid, t).alias("raw"), F.when(~valid, F.lit("Invalid JSON")).alias("error"))

    return F.transform(jsonld_texts(html), block)


def jsonld_records(html: Column) -> Column:
    """``array<string>``: items of arrays and of ``@graph``, other valid blocks themselves, invalid ones dropped."""
    def items(t: Column) -> Column:
        graph = F.get_json_object(t, "$['@graph']")
        whole = F.when(t.startswith("["), t).when(graph.startswith("["), graph)
        listed = F.transform(F.from_json(whole, "array<variant>"), lambda v: F.to_json(v))
        return F.when(~is_json(t) | (t == "null"), F.array().cast("array<string>")).when(whole.isNotNull(), listed).otherwise(F.array(t))

    return F.flatten(F.transform(jsonld_texts(html), items))
