"""Main text of web pages by tag-path ratios.

A page is read once as a stream of tags and text.  Its text falls into blocks, the runs of
text between the borders of block elements; a block belongs to the path of block elements,
with their classes, from the root to it.  Over each path the text length outside links and the
punctuation are aggregated, each a block; their fusion (length times one plus punctuation) is
the path's ratio.  The ratios are smoothed along the page with a small Gaussian window; the
geometric mean of a block's own and its smoothed ratio is weighed by what elements say they are
(below).  Paths whose mean reaches the threshold (the deviation over the page, at most half of the largest, at least ``FLOOR``) are
content.  Short blocks of an article (headings, list items) have low ratios on their own, so every
block within the smallest element that holds all content blocks counts as content too.  Where that
element is the body itself, the same holds for each element below it that has content blocks;
what lies between two content blocks that stand in the body without a container, and headings,
lists, tables and the like that follow on content blocks or lead to them there, are content
unless they are links for the most part.

What elements say they are is a prior, no verdict.  Text in menus, headers, footers, sidebars,
notices, adverts, forms and comments, by their tag, role, class or id, weighs ``MARKED`` of its
ratio, and text outside the page's article or main element ``BESIDE``: it is content where the page
has nothing that comes near it.  Within the article a class of the ``SOFT`` words alone weighs ``INNER``: such a block is drawn in by its place if
its own weighed ratio reaches ``SPOKEN``, as that of a long block with punctuation does.  A header within an article keeps its headings.  A mark does not
count where it stands on most of the article: on an element, or on all elements of a class together,
that hold more than half of the text outside links of the page's article or main element (of the
page, if there is none with a twentieth of its text), if they hold an article or several blocks and
are no menu, header, footer or the like by tag or role.  Scripts, styles, markup and what is hidden are
never text, nor are phrases within a block that say they are no part of it.

Character references are decoded, white space within a block (line breaks and no-break
spaces too) becomes one space, blocks are joined in page order by a newline.

Defined cases: a null or empty page has the empty text; a page that breaks off counts up to
there (an unfinished tag is markup, an unfinished script has no text); elements left open end
with their parent; repeated rows are judged alike; an empty table gives no rows; a column named like
one of the result, case aside, gives way to it.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyrill.llm.shared import arrow_map

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|iframe|svg|object|textarea|title|select)\b[^>]*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*+)(?P<rest2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…¿¡。，、；：！？]")
SPACE = re.compile(r"\s+")

#: What text weighs that says it is no article, what it weighs where only a class or id within the article says so, what text beside
#: the article element weighs, the least ratio of content, and that of a paragraph that speaks for itself.
MARKED, INNER, BESIDE, FLOOR, SPOKEN = 1e-5, 0.1, 1e-2, 1.0, 50.0

# Elements by kind, words that mark an element as no article, and those that within an article may mean its own matter.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - set("body html td th tr tbody thead tfoot caption".split())
OUTSIDE = set("head nav header footer aside form button menu dialog input label fieldset canvas audio video noscript".split())
FORMS = set("form fieldset label noscript".split())
HOMES = ("article", "main")
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MARKS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments disqus reply replies cookie cookies consent gdpr notice alert popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login widget toolbar pagination pager skip sidenav subnav topnav topbar rail copyright paywall teaser".split())
SOFT = set("related skip share sharing social rail overlay alert notice widget promotion teaser copyright".split())
OWN = set("article content entry post story main".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
FLOW = HEADINGS | set("p ul ol dl table pre blockquote figure details hr".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}


class Element:
    __slots__ = ("blocks", "classes", "hidden", "holds", "label", "marked", "outside", "parent", "soft", "strict", "tag", "weight", "within")

    def __init__(self, tag: str, label: str, parent: Element | None, hidden: bool, within: bool, marked: bool = False, strict: bool = False, classes: tuple[str, ...] = ()) -> None:
        self.tag, self.label, self.parent, self.hidden, self.within = tag, label, parent, hidden, within
        self.marked, self.strict, self.classes = marked, strict, classes  # by tag, role or id; by tag or role alone; the classes that say so
        self.soft, self.outside, self.weight, self.blocks, self.holds = False, False, 0, 0, tag in HOMES  # known once the page is read


class Block:
    __slots__ = ("element", "linked", "parts", "prior")

    def __init__(self, element: Element) -> None:
        self.element, self.parts, self.linked, self.prior = element, [], 0, 1.0


def _says(value: str, within: bool) -> bool:
    words = set(re.split(r"[\s_-]+", value))
    return bool(words & MARKS) or ("header" in words and not within)


def _open(tag: str, rest: str, parent: Element) -> Element:
    hidden, marked = parent.hidden or tag == "head", False
    within = parent.within or parent.tag in HOMES
    names: list[str] = []
    ids: list[str] = []
    role = ""
    if rest and not rest.isspace():
        for m in ATTRIBUTE.finditer(rest):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                hidden = True
            elif name == "role":
                role = value
            elif name == "class":
                names += value.split()
            elif name == "id":
                ids.append(value)
    classes: tuple[str, ...] = ()
    if tag not in ("html", "body"):
        own = lambda values: within or any(set(re.split(r"[\s_-]+", v)) & OWN for v in values)
        if names:
            at_home = own(names)
            classes = tuple(dict.fromkeys(n for n in names if _says(n, at_home)))
        marked = any(_says(v, own([v])) for v in ids)
    strict = role in ROLES - FORMS or (tag in OUTSIDE - FORMS and not (tag == "header" and within))
    marked = marked or strict or role in ROLES or tag in FORMS
    return Element(tag, ".".join([tag, *sorted(names)]), parent, hidden, within, marked, strict, classes)


def _judge(elements: list[Element]) -> dict[int, bool]:
    """Sets ``outside`` of all elements, parents first; ``weight`` holds each one's own text outside links.
    Returns which elements, by identity, lie in the page's article or main element (all, if it has none)."""
    for e in reversed(elements[1:]):
        e.parent.weight += e.weight
        e.parent.blocks += e.blocks
        e.parent.holds |= e.holds
    scope = _scope(elements)
    around: set[int] = set()
    e = scope
    while e is not None:
        around.add(id(e))
        e = e.parent
    inside: dict[int, bool] = {}
    chain: dict[int, frozenset[str]] = {id(elements[0]): frozenset()}
    by_class: dict[str, tuple[int, int, bool]] = {}
    for e in elements:
        inside[id(e)] = e is scope or (e.parent is not None and inside[id(e.parent)])
        if e.parent is None:
            continue
        above = chain[id(e.parent)]
        for c in e.classes:
            if c not in above:
                weight, blocks, holds = by_class.get(c, (0, 0, False))
                by_class[c] = weight + _share(e, scope, inside, around), blocks + e.blocks, holds or e.holds
        chain[id(e)] = above | frozenset(e.classes) if e.classes else above
    void = {c for c, (weight, blocks, holds) in by_class.items() if (holds or blocks > 1) and 2 * weight > scope.weight}
    for e in elements[1:]:
        much = not e.strict and (e.marked or bool(e.classes)) and (e.holds or e.blocks > 1) and 2 * _share(e, scope, inside, around) > scope.weight
        counting = [] if much else [c for c in e.classes if _counts(c, void, e.within)]
        doubt = e.within and e.tag in BLOCK and all(set(re.split(r"[_-]+", c)) & MARKS <= SOFT for c in counting)
        e.outside = e.parent.outside or e.hidden or (not much and e.marked) or (bool(counting) and not doubt)
        e.soft = e.parent.soft or (bool(counting) and doubt)
        if e.within and e.tag in HEADINGS and e.parent.tag == "header" and not e.parent.parent.outside:
            e.outside = e.hidden
    return {id(e): scope.parent is None or e.within or e.tag in HOMES for e in elements}


def _share(e: Element, scope: Element, inside: dict[int, bool], around: set[int]) -> int:
    """The text of the scope that the element holds."""
    return e.weight if inside[id(e)] else scope.weight if id(e) in around else 0


def _counts(name: str, void: set[str], within: bool) -> bool:
    """Whether a marked class counts: not if it stands on most of the article, nor by what it has from such a class."""
    for v in void:
        if name == v:
            return False
        if name.startswith((v + "-", v + "_")):
            name = name[len(v) + 1 :]
            return _says(name, within)
    return True


def _scope(elements: list[Element]) -> Element:
    """The page's article or main element: that with most text, halved for each marked element on its way; else the page."""
    marks: dict[int, int] = {}
    home: dict[int, Element | None] = {}  # the nearest such element around, or itself
    within: dict[int, list[Element]] = {}
    best, most = elements[0], 0.0
    for e in elements:
        marks[id(e)] = (marks[id(e.parent)] if e.parent is not None else 0) + bool(e.marked or e.classes)
        home[id(e)] = outer = home[id(e.parent)] if e.parent is not None else None
        if e.tag in HOMES and not e.hidden and 20 * e.weight > elements[0].weight:
            home[id(e)] = e
            if outer is not None and marks[id(e)] == marks[id(outer)]:
                within.setdefault(id(outer), []).append(e)
            score = e.weight * 0.5 ** min(marks[id(e)], 60)
            if score > most:
                best, most = e, score
    while len(within.get(id(best), ())) == 1:  # an article alone in it, with no further mark, is meant
        best = within[id(best)][0]
    return best


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in page order."""
    out: list[Block] = []
    top = Element("#root", "#root", None, False, False)
    elements = [top]
    now, block, links = top, None, 0

    def text(raw: str) -> None:
        nonlocal block
        if now.hidden or not raw:
            return
        if block is None:
            home = now
            while home.tag not in BLOCK and home.parent is not None:
                home = home.parent
            if raw.isspace():
                return
            block = Block(home)
            out.append(block)
            home.blocks += 1
        decoded = entities.unescape(raw)
        block.parts.append((now, decoded, links > 0))
        if not links:
            now.weight += len(decoded) - decoded.count(" ")

    def leave(to: Element) -> None:
        nonlocal now, block, links
        while now is not to:
            if now.tag == "a":
                links -= 1
            if now.tag in BLOCK:
                block = None
            now = now.parent

    at = 0
    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m["raw"] or not (tag := (m["tag"] or m["tag2"] or "").lower()):
            continue
        if m["end"] or m["end2"]:
            found = now
            while found is not top and found.tag != tag:
                found = found.parent
            if found is not top:
                leave(found.parent)
            if tag in BLOCK:
                block = None
            continue
        if tag in BLOCK:
            block = None
        if tag == "br" and block is not None:
            block.parts.append((now, " ", False))
        if tag in VOID:
            continue
        if tag in CLOSES_P or tag in SAME:
            ends = {"p"} if tag in CLOSES_P else set()
            ends |= SAME.get(tag, set())
            stop = BARRIER.get(tag, set()) | {"article", "section", "main", "body", "table", "td", "th", "div"}
            last, look = None, now
            while look is not top and (look.tag not in stop or look.tag in ends):
                if look.tag in ends:
                    last = look
                look = look.parent
            if last is not None:
                leave(last.parent)
        rest = m["rest"] if m["tag"] else m["rest2"]
        now = _open(tag, rest, now)
        elements.append(now)
        if tag == "a":
            links += 1
        if rest.endswith("/") and tag not in BLOCK:
            leave(now.parent)
    text(page[at:])
    at_home = _judge(elements)
    for b in out:
        outside = b.element.outside
        b.prior = (MARKED if outside else INNER if b.element.soft else 1.0) * (1.0 if at_home[id(b.element)] else BESIDE)
        b.linked = sum(len(t) for e, t, linked in b.parts if linked and (outside or not e.outside))
        b.parts = [t for e, t, _ in b.parts if outside or not e.outside]
    return [b for b in out if b.parts]


def _path(element: Element, known: dict[int, str]) -> str:
    chain = []
    while element is not None and id(element) not in known:
        chain.append(element)
        element = element.parent
    path = known[id(element)] if element is not None else ""
    for e in reversed(chain):
        path = f"{path}/{e.label}{'!' if e.outside else '?' if e.soft else ''}" if e.tag in BLOCK else path
        known[id(e)] = path
    return path


def ratios(blocks: list[Block], texts: list[str]) -> tuple[list[str], dict[str, float], float]:
    """The path of each block, each path's mean of weighed smoothed ratios, and their deviation over the blocks."""
    known: dict[int, str] = {}
    paths = [_path(b.element, known) for b in blocks]
    sums: dict[str, list[float]] = {}
    for b, p, t in zip(blocks, paths, texts, strict=True):
        s = sums.setdefault(p, [0, 0, 0])
        s[0] += max(0, len(t) - b.linked)
        s[1] += len(PUNCTUATION.findall(t)) if len(t) > b.linked else 0
        s[2] += 1
    raw = [sums[p][0] / sums[p][2] * (1 + sums[p][1] / sums[p][2]) for p in paths]
    last = len(raw) - 1
    smooth = [b.prior * math.sqrt(raw[i] * (raw[max(0, i - 1)] + 2 * raw[i] + raw[min(last, i + 1)]) / 4) for i, b in enumerate(blocks)]
    by: dict[str, list[float]] = {}
    for p, s in zip(paths, smooth, strict=True):
        by.setdefault(p, []).append(s)
    return paths, {p: sum(v) / len(v) for p, v in by.items()}, _deviation(smooth)


def _deviation(values: list[float]) -> float:
    mean = sum(values) / len(values)
    return math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


def _chain(element: Element) -> list[Element]:
    """From the root to the element."""
    chain = []
    while element is not None:
        chain.append(element)
        element = element.parent
    return chain[::-1]


def _smallest(elements: list[Element]) -> Element:
    """The smallest element around all; that of a paragraph is what the paragraph stands in."""
    common = elements[0]
    chain = _chain(common)
    at = {id(e): d for d, e in enumerate(chain)}
    depth, seen = len(chain) - 1, set()
    for e in elements[1:]:
        while id(e) not in at and id(e) not in seen:
            seen.add(id(e))
            e = e.parent
        depth = min(depth, at.get(id(e), depth))
    common = chain[depth]
    return common.parent if common.tag == "p" and common.parent is not None else common


def _recovered(blocks: list[Block], texts: list[str], chosen: set[int]) -> set[int]:
    """Blocks below the threshold that belong to the article by where they stand."""

    def held(by: Element, among: range | list[int]) -> set[int]:
        known = {id(by): True}
        for i in among:
            way, e = [], blocks[i].element
            while e is not None and id(e) not in known:
                way.append(id(e))
                e = e.parent
            known.update(dict.fromkeys(way, e is not None and known[id(e)]))
        return {i for i in among if known[id(blocks[i].element)]}

    everything = range(len(blocks))
    common = _smallest([blocks[i].element for i in sorted(chosen)])
    if common.tag not in ("#root", "html", "body"):
        return held(common, everything)
    tops: dict[int, Element | None] = {id(common): None}  # the element below the common one, on the way to each

    def top(e: Element) -> Element | None:
        way = []
        while e is not None and id(e) not in tops:
            way.append(e)
            e = e.parent
        found = tops[id(e)] if e is not None else None
        if way and (e is common or e is None):
            found = way[-1]
        tops.update((id(x), found) for x in way)
        return found

    at = [top(b.element) for b in blocks]
    loose = [t is None or t.tag in FLOW for t in at]
    plain = [2 * b.linked < len(t) for b, t in zip(blocks, texts, strict=True)]
    found = set(chosen)
    regions: dict[int, tuple[list[int], list[int]]] = {}
    for i in everything:
        if not loose[i]:
            every, own = regions.setdefault(id(at[i]), ([], []))
            every.append(i)
            if i in chosen:
                own.append(i)
    for every, own in regions.values():
        if own:
            found |= held(_smallest([blocks[i].element for i in own]), every)
    ends = [i for i in sorted(chosen) if loose[i]]
    for a, b in zip(ends, ends[1:], strict=False):
        found |= {i for i in range(a + 1, b) if plain[i]}
    joins = [plain[i] and (loose[i] or blocks[i].element.tag in HEADINGS) for i in everything]
    for order, back in ((everything, -1), (everything[::-1], 1)):
        for i in order:
            if joins[i] and i + back in found:
                found.add(i)
    return found


def _ratio(block: Block, text: str) -> float:
    """A block's own."""
    return max(0, len(text) - block.linked) * (1 + len(PUNCTUATION.findall(text)))


def main_text(page: str | None) -> str:
    blocks, texts = [], []
    for b in blocks_of(page or ""):
        if line := SPACE.sub(" ", "".join(b.parts)).strip():
            blocks.append(b)
            texts.append(line)
    if not blocks:
        return ""
    paths, mean, deviation = ratios(blocks, texts)
    threshold = max(FLOOR, min(deviation, max(mean.values()) / 2))
    chosen = {i for i, p in enumerate(paths) if mean[p] >= threshold}
    if chosen:
        least = min(blocks[i].prior for i in chosen)
        chosen |= {i for i in _recovered(blocks, texts, chosen) if (INNER * _ratio(blocks[i], texts[i]) >= SPOKEN if blocks[i].element.soft else blocks[i].prior >= least)}
    return "\n".join(t for i, t in enumerate(texts) if i in chosen)


TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Rows of ``pages`` with ``text`` and ``n_chars`` (its code points)."""

    def make():
        def step(batch: pa.RecordBatch):
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}, None

        return step

    return arrow_map(pages, make, {"html": html_col}, TEXT, keep)
