"""A page's text as it is laid out, in one pass over its tags: block, inline and preserved white space.

The pass keeps what a renderer keeps: whether white space is preserved (``pre``, ``textarea``), whether an element is shown, and how many line
breaks the borders of blocks ask for: two around a paragraph, one around other blocks, where neighbouring borders ask once.  ``br`` is a line
break of its own, cells of a row are set apart by a tab, and white space in lines of text is one space, none at a line's ends.

Character references are decoded as a browser decodes them, some of them without their semicolon; ``closed``: only those with it, the rest is text.

Defined cases: null and empty pages have the empty text; the title and the rest of the head are not laid out; what is left open ends with the page.
"""

from __future__ import annotations

import re
from collections import Counter
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that begin a line of their own, those set apart by an empty line, and those that are not laid out.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option pre section summary table tbody tfoot thead tr ul".split())
HIDDEN = frozenset("head script style template noscript title object svg iframe canvas video audio".split())
KEPT = frozenset(("pre", "textarea"))
TABLES = frozenset("table thead tbody tfoot tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE = re.compile(r"[ \t\n\f\r]+")
REFERENCE = re.compile(r"&(?:(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)?")


class Layout(HTMLParser):
    """``out``: texts, and numbers of line breaks that are asked for."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str | int] = []
        self.open: list[tuple[str, bool]] = []  # elements, and whether each is not shown
        self.inside: Counter[str] = Counter()
        self.hidden = self.kept = 0  # open elements that are not shown, and that preserve white space
        self.cell = False

    def _border(self, tag: str) -> None:
        if not self.hidden and (tag == "p" or tag in BLOCKS):
            self.out.append(2 if tag == "p" else 1)

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "br":
            if not self.hidden:
                self.out.append("\n")
            return
        gone = tag in HIDDEN or "hidden" in given or bool(re.search(r"display\s*:\s*none", given.get("style") or "", re.I))
        if not gone:
            self._border(tag)
        if tag in ("td", "th") and not self.hidden:
            if self.cell:
                self.out.append("\t")
            self.cell = True
        if tag == "tr":
            self.cell = False
        if tag in VOID:
            return
        self.open.append((tag, gone))
        self.inside[tag] += 1
        self.hidden += gone
        self.kept += tag in KEPT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.inside[tag]:
            return
        name = None
        while name != tag:
            name, gone = self.open.pop()
            self.inside[name] -= 1
            self.hidden -= gone
            self.kept -= name in KEPT
            if not gone:
                self._border(name)

    def handle_data(self, data):
        between = self.open and self.open[-1][0] in TABLES and data.isspace()
        if not self.hidden and data and not between:
            self.out.append(data if self.kept else SPACE.sub(" ", data))

    def text(self) -> str:
        parts, asked = [], 0
        line = ""  # the end of what is there, as far as white space goes
        for x in self.out:
            if isinstance(x, int):
                asked = max(asked, x)
                continue
            if x == " " and (asked or not line or line[-1] in " \n\t"):
                continue
            if asked and line:
                while parts and parts[-1].endswith(" "):
                    parts[-1] = parts[-1][:-1]
                parts.append("\n" * asked)
                line = "\n"
            asked = 0
            if x[0] == " " and (not line or line[-1] in " \n\t"):
                x = x[1:]
            if x == "\n" and parts and parts[-1].endswith(" "):
                parts[-1] = parts[-1][:-1]
            if x:
                parts.append(x)
                line = x
        return "".join(parts).strip(" \n\t")


def _kept(m: re.Match) -> str:
    """A reference as it is; an ampersand that begins none, as one."""
    name = m[1]
    return m[0] if name and (name[0] == "#" or f"{name};" in html5) else f"&amp;{m[0][1:]}"


def laid_out_text(page: str | None, closed: bool = False) -> str:
    layout = Layout()
    layout.feed(REFERENCE.sub(_kept, page or "") if closed else page or "")
    layout.close()
    return layout.text()


def laid_out(page: Column | str, closed: bool = False) -> Column:
    """The text of each page as it is laid out."""

    @F.pandas_udf(T.StringType())
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: laid_out_text(p, closed))

    return text(page)
