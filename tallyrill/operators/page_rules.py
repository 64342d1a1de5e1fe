"""Accessibility rules that a page's source answers: one fold over its elements, in page order, on the JVM.

A page is cut into its tags; each rule looks at the sequence of start tags.  Rules: headings begin with ``h1`` and go down one level at
a time; a page has one ``main``, a ``lang`` and a title; an image has an ``alt``; a field has a label (``aria-label``, ``aria-labelledby``,
``title``, a ``label for`` its id, or a label around it); a link and a button have a name; an id occurs once.  A finding names the element
by its place among the page's elements of that tag (``img[3]``).

Pages are dealt out ``PART`` bytes of source a task, whatever the size of the table, and only what the rules ask of a tag is sorted; each window
passes over a page once.

Defined cases: a null or empty page has no findings; what stands in comments, scripts, styles and templates is no element; repeated rows are
judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrill.functions.html import SCRIPT, STYLE

TAG = r"(?s)<(/?[A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>([^<]*)"
HIDDEN = [r"(?s)<!--.*?-->", SCRIPT, STYLE, r"(?is)<template\b.*?</template>"]
FIELDS = ("input", "select", "textarea")
UNLABELLED = ("hidden", "submit", "reset", "button", "image")
#: Bytes of pages whose tags a task sorts.
PART = 16 << 20
# The rules and how grave they are.
RULES = {"heading-order": "moderate", "landmark-one-main": "moderate", "html-has-lang": "serious", "document-title": "serious", "image-alt": "critical", "label": "critical", "link-name": "serious", "button-name": "critical", "duplicate-id": "minor"}


def attribute(rest: Column, name: str) -> Column:
    """An attribute's value within the text of a tag; null where it is not there."""
    pattern = rf"(?is)(?:^|[\s\"'/]){name}(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)"
    there = rest.rlike(pattern)
    return F.when(there, F.concat(*(F.regexp_extract(rest, pattern, i) for i in (1, 2, 3))))


def elements(html: Column) -> Column:
    """``array<struct<tag, rest, text>>`` of all tags in page order: end tags begin with a slash; ``text`` is what follows up to the next tag."""
    for pattern in HIDDEN:
        html = F.regexp_replace(html, pattern, "")
    found = F.regexp_extract_all(html, F.lit(TAG), F.lit(0))
    return F.transform(found, lambda t: F.struct(F.lower(F.regexp_extract(t, TAG, 1)).alias("tag"), F.regexp_extract(t, TAG, 2).alias("rest"), F.regexp_extract(t, TAG, 3).alias("text")))


def _tags(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """A row for each tag, ``_row, page, at, tag`` and what the rules ask of it: numbers, flags and ids, none of the page's text."""
    numbered = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("page"), elements(F.col(html_col)).alias("_e"))  # before rows are made of it
    tags = numbered.select("_row", "page", F.posexplode("_e").alias("at", "e")).select("_row", "page", "at", "e.*")
    tag, rest, text = F.col("tag"), F.col("rest"), F.trim("text")
    said = lambda name: F.coalesce(attribute(rest, name), F.lit(""))
    has = lambda *names: F.coalesce(*(F.nullif(F.trim(attribute(rest, n)), F.lit("")) for n in names)).isNotNull()
    own = F.when(tag == "img", F.length(said("alt"))).otherwise(0)
    kind = F.lower(F.coalesce(attribute(rest, "type"), F.lit("text")))
    asked = {
        "_level": F.when(tag.rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int")),
        "_own": own,
        "_said": own + F.length(text) + F.length(said("aria-label")),
        "_text": F.length(text),
        "_id": F.when(~tag.startswith("/"), attribute(rest, "id")),
        "_for": F.when(tag == "label", attribute(rest, "for")),
        "_bare": F.when(tag == "img", attribute(rest, "alt").isNull() & ~has("aria-label", "aria-labelledby"))
        .when(tag.isin(*FIELDS), ~((tag == "input") & kind.isin(*UNLABELLED)) & ~has("aria-label", "aria-labelledby", "title"))
        .when(tag == "a", attribute(rest, "href").isNotNull() & ~has("aria-labelledby", "title"))
        .when(tag == "button", ~has("aria-labelledby", "title")).otherwise(False),
        "_lang": (tag == "html") & (said("lang") != ""),
        "_title": (tag == "title") & (text != ""),
    }
    return tags.select("_row", "page", "at", "tag", *(c.alias(n) for n, c in asked.items()))


def findings(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page, rule, impact, node``: a row for each breach; ``node`` is null where the page as a whole breaks a rule."""
    size = pages.agg(F.sum(F.octet_length(html_col))).first()[0] or 0
    parts = max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // PART))
    whole = Window.partitionBy("_row")
    page = whole.orderBy("at")
    up_to = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tag, level = F.col("tag"), F.col("_level")
    opened = F.sum(F.when(tag == "label", 1).when(tag == "/label", -1).otherwise(0)).over(up_to)
    of_page = {"_mains": F.count_if(tag == "main").over(whole), "_fors": F.collect_set("_for").over(whole), "_has_lang": F.max("_lang").over(whole), "_has_title": F.max("_title").over(whole)}
    rows = _tags(pages, id_col, html_col).repartition(parts, "_row")
    rows = rows.withColumns({"_total": F.sum("_said").over(up_to), "_in_label": opened > 0, "_last": F.last(level, ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, -1)), **of_page})  # text so far, so what an element holds is a difference
    back = whole.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    closes = lambda name: F.last(F.when(tag == f"/{name}", F.col("_total") - F.col("_text")), ignorenulls=True).over(back)
    number = F.row_number().over(Window.partitionBy("_row", "tag").orderBy("at"))
    earlier = F.row_number().over(Window.partitionBy("_row", "_id").orderBy("at"))
    rows = rows.withColumns({"_end": F.when(tag == "a", closes("a")).when(tag == "button", closes("button"))}).withColumn("number", number).withColumn("_same", earlier)
    nameless = F.coalesce("_end", F.lit(0)) - F.col("_total") + F.col("_said") - F.col("_own") <= 0
    broken = {
        "heading-order": level.isNotNull() & (level > F.coalesce("_last", F.lit(0)) + 1),
        "image-alt": (tag == "img") & F.col("_bare"),
        "label": tag.isin(*FIELDS) & F.col("_bare") & ~F.coalesce(F.array_contains("_fors", F.col("_id")), F.lit(False)) & ~F.col("_in_label"),
        "link-name": (tag == "a") & F.col("_bare") & nameless,
        "button-name": (tag == "button") & F.col("_bare") & nameless,
        "duplicate-id": F.col("_id").isNotNull() & (F.col("_id") != "") & (F.col("_same") > 1),
    }
    first = F.col("at") == 0  # what the page as a whole breaks is told once
    broken_by_page = {"landmark-one-main": first & (F.col("_mains") != 1), "html-has-lang": first & ~F.col("_has_lang"), "document-title": first & ~F.col("_has_title")}
    node = F.concat("tag", F.lit("["), F.col("number"), F.lit("]"))
    told = [F.when(test, F.struct(F.lit(rule).alias("rule"), (node if rule in broken else F.lit(None).cast("string")).alias("node"))) for rule, test in (broken | broken_by_page).items()]
    each = rows.select("page", F.explode(F.filter(F.array(*told), lambda r: r.isNotNull())).alias("r")).select("page", "r.*")
    impact = F.element_at(F.create_map(*(F.lit(x) for pair in RULES.items() for x in pair)), F.col("rule"))
    return each.select("page", "rule", impact.alias("impact"), "node")
