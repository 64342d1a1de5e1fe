"""Pages as tables: link and image checks, forms, selector records, ranked search hits."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tallyrill.functions import html as H
from tallyrill.functions.selectors import compiled as matcher
from tallyrill.functions.text import strip, text_or
from tallyrill.functions.urls import resolved

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


#: Bytes of a batch of pages on its way to a Python worker; a batch holds one page at least.
BATCH = 8 << 20


def _mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInPandas`` in batches bounded by bytes, so that long pages do not add up in a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df.mapInPandas(run, schema)


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, position, text, href`` of every link."""
    return pages.select(id_col, F.posexplode(H.links(F.col(html_col))).alias("position", "l")).select(id_col, "position", "l.text", "l.href")


def page_urls(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``id, position, text, href, url`` of every link, with its absolute address (after the page's ``base``)."""
    found = pages.select(id_col, H.base_of(F.col(html_col), F.col(url_col)).alias("_base"), F.posexplode(H.links(F.col(html_col))).alias("position", "l"))
    return found.select(id_col, "position", "l.text", "l.href", resolved(F.col("_base"), F.col("l.href")).alias("url"))


def page_headings(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    found = pages.select(id_col, F.posexplode(H.headings(F.col(html_col))).alias("position", "h"))
    return found.select(id_col, "position", "h.tag", "h.text", H.indented(F.col("h.tag"), F.col("h.text")).alias("outline"))


def page_overview(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Title and headings 1 to 3: what is left without a strategy or selector."""
    return pages.select(id_col, H.title(F.col(html_col)).alias("title"), F.transform(H.headings(F.col(html_col), 3, 1 << 30), lambda h: h["text"]).alias("headings"))


def page_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", shown: int = 2000) -> DataFrame:
    text = H.body_text(F.col(html_col))
    return pages.select(id_col, text.alias("text")).select(id_col, F.length("text").cast("long").alias("n_chars"), F.substring("text", 1, shown).alias("shown"), F.greatest(F.length("text") - shown, F.lit(0)).cast("long").alias("hidden"))


def link_ok(status: Column) -> Column:
    """Below 400, and answered at all (0 is a failed request)."""
    return F.coalesce((status > 0) & (status < 400), F.lit(False))


def link_summary(checked: DataFrame, by: str, most: int = 50) -> DataFrame:
    """From ``by, position, status``: ``total, checked, broken`` and the details of the first ``most`` links of each page."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("position"))
    rows = checked.withColumn("_r", place)
    inside = F.col("_r") <= most
    detail = F.struct("_r", *[c for c in checked.columns if c != by], link_ok(F.col("status")).alias("ok"))
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(inside).alias("checked"), F.count_if(inside & ~link_ok(F.col("status"))).alias("broken"), F.transform(F.array_sort(F.collect_list(F.when(inside, detail))), lambda d: d.dropFields("_r")).alias("details"))


def image_summary(images: DataFrame, by: str) -> DataFrame:
    """From ``by, src, alt, natural_width, complete`` (and ``position``): ``total, broken, missing_alt`` and ``details``, a page's images
    by position, where there is one, else by source; an image without a text says so."""
    alt = F.coalesce("alt", F.lit(""))
    shown = F.when(alt == "", "(no alt text)").otherwise(alt)
    place = [F.col("position")] if "position" in images.columns else []
    detail = F.struct(*place, F.col("src"), shown.alias("alt"), "natural_width", "complete")
    details = F.array_sort(F.collect_list(detail))
    return images.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("complete") & (F.col("natural_width") == 0)).alias("broken"), F.count_if(alt.isin("", "(no alt text)")).alias("missing_alt"), (F.transform(details, lambda d: d.dropFields("position")) if place else details).alias("details"))


def console_errors(messages: DataFrame, most: int = 20, order: str = "position") -> DataFrame:
    return messages.where(F.col("type") == "error").orderBy(order).limit(most)


# --- elements -----------------------------------------------------------------------------


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children, self.place = tag, attrs, parent, [], 0  # among its parent's elements, from 0

    def text(self) -> str:
        parts, left = [], [self]
        while left:
            node = left.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                left += reversed(node.children)
        return "".join(parts)

    def below(self):
        """The elements below, in page order."""
        left = self.children[::-1]
        while left:
            node = left.pop()
            if isinstance(node, Node):
                yield node
                left += reversed(node.children)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.now.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.now))

    def handle_endtag(self, tag):
        at = self.now
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None and at.parent is not None:
            self.now = at.parent

    def handle_data(self, data):
        self.now.children.append(data)


def tree(page: str) -> Node:
    parser = _Tree()
    parser.feed(page)
    parser.close()
    return parser.root


def select_records(pages: DataFrame, selector: str, fields: dict[str, str] | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, position`` and a column for each field (its selector's first match, else empty); ``text`` without fields."""
    names = list(fields or {"text": ""})
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(key, *row) for key, page in zip(batch[id_col], batch[html_col], strict=True) for row in _rows(page, selector, fields)]
            yield pd.DataFrame(rows, columns=[id_col, "position", *names])

    return _mapped(pages.select(id_col, html_col), run, f"{id_col} {kind}, position int, " + ", ".join(f"`{n}` string" for n in names))


def _rows(page: str | None, selector: str, fields: dict[str, str] | None):
    """A tuple for each match: its place and the texts of its fields."""
    main, parts = matcher(selector), [matcher(s) for s in (fields or {}).values()]
    for i, node in enumerate(n for n in tree(page or "").below() if main(n)):
        yield (i, *(next((c.text().strip() for c in node.below() if p(c)), "") for p in parts)) if fields else (i, node.text().strip())


class SelectRecords:
    """``select_records(html, selector[, fields])``: a row for each match, in page order.

    ``selector`` and ``fields``, a map from column to selector, are constants, and the columns follow from them: ``position``, from 0,
    and a text column for each field (the stripped text of its selector's first match below, else empty); ``text``
    without fields.  A null page has no rows.
    """

    @staticmethod
    def analyze(html: AnalyzeArgument, selector: AnalyzeArgument, fields: AnalyzeArgument | None = None) -> AnalyzeResult:
        given = [("selector", selector)] + ([("fields", fields)] if fields is not None else [])
        for name, argument in given:
            if not argument.isConstantExpression:
                raise ValueError(f"{name} must be a constant")
        for text in [selector.value, *(fields.value or {}).values()] if fields is not None else [selector.value]:
            matcher(text)
        schema = T.StructType().add("position", T.IntegerType())
        for name in (fields.value if fields is not None else None) or {"text": ""}:
            schema = schema.add(name, T.StringType())
        return AnalyzeResult(schema)

    def eval(self, html, selector, fields=None):
        if html is not None:
            yield from _rows(html, selector, dict(fields) if fields else None)


def register(spark: SparkSession) -> None:
    """Makes ``select_records`` a table function of SQL, for ``LATERAL`` joins."""
    spark.udtf.register("select_records", F.udtf(SelectRecords))


def page_forms(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, form_index, action, method, fields``: a form's inputs, selects and text areas in page order."""
    kind = pages.schema[id_col].dataType.simpleString()
    defaults = {"input": "text", "select": "select-one", "textarea": "textarea"}

    def run(batches):
        for batch in batches:
            rows = []
            for key, page in zip(batch[id_col], batch[html_col], strict=True):
                for i, form in enumerate(n for n in tree(page or "").below() if n.tag == "form"):
                    fields = [{"tag": n.tag, "type": n.attrs.get("type", "").lower() or ("select-multiple" if n.tag == "select" and "multiple" in n.attrs else defaults[n.tag]), "name": n.attrs.get("name", ""), "id": n.attrs.get("id", ""), "placeholder": n.attrs.get("placeholder", ""), "required": "required" in n.attrs} for n in form.below() if n.tag in defaults]
                    rows.append((key, i, form.attrs.get("action", ""), form.attrs.get("method", "get").lower() or "get", fields))
            yield pd.DataFrame(rows, columns=[id_col, "form_index", "action", "method", "fields"])

    fields = "tag: string, type: string, name: string, id: string, placeholder: string, required: boolean"
    return _mapped(pages.select(id_col, html_col), run, f"{id_col} {kind}, form_index int, action string, method string, fields array<struct<{fields}>>")


# --- search hits --------------------------------------------------------------------------


def rank_hits(hits: DataFrame, query: str, position: str, most: int, excluded: tuple[str, ...] = (), dense: bool = True) -> DataFrame:
    """Hits of each query: the first ``most`` positions (from 0), then without excluded hosts or links that are not http, ranked from 1.

    The cap comes before the filter, so fewer than ``most`` may remain. ``dense=False`` ranks by raw position.
    """
    ok = F.col("url").startswith("http")
    for host in excluded:
        ok = ok & ~F.contains(F.col("url"), F.lit(host))
    kept = hits.where((F.col(position) < most) & ok).withColumn("title", text_or(F.coalesce("title", F.lit("")), "(no title)")).withColumn("snippet", strip(F.coalesce("snippet", F.lit(""))))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(position)) if dense else F.col(position) + 1
    return kept.withColumn("rank", rank.cast("int"))


def external_links(hits: DataFrame, query: str, position: str, most: int, excluded: tuple[str, ...] = ()) -> DataFrame:
    """The fall-back: any outside link with a text of more than three characters, cut to 200, the first ``most`` that remain."""
    ok = F.col("url").startswith("http") & (F.length(strip(F.coalesce("title", F.lit("")))) > 3)
    for host in excluded:
        ok = ok & ~F.contains(F.col("url"), F.lit(host))
    place = F.row_number().over(Window.partitionBy(query).orderBy(position))
    return hits.where(ok).withColumn("rank", place.cast("int")).where(F.col("rank") <= most).withColumn("title", F.substring(strip(F.col("title")), 1, 200)).withColumn("snippet", F.lit(""))


def first_source(sources: list[DataFrame], query: str) -> DataFrame:
    """For each query the rows of the first source that has any."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t, allowMissingColumns=True)
    best = rows.groupBy(query).agg(F.min("_source").alias("_best"))
    return rows.join(best, query).where("_source = _best").drop("_source", "_best")


def zipped(links: Column, snippets: Column) -> Column:
    """Links with the snippets at their places; a missing snippet is empty."""
    return F.transform(links, lambda link, i: F.struct(link.alias("link"), F.coalesce(F.get(snippets, i), F.lit("")).alias("snippet")))


def engine_hits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", entry: str = ".b_algo", most: int = 10) -> DataFrame:
    """Title, link and snippet of each entry of a result page, ranked by raw position."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        is_entry, head, anchor, caption, para = matcher(entry), matcher("h2 a"), matcher("a"), matcher(".b_caption p"), matcher("p")
        for batch in batches:
            rows = []
            for key, page in zip(batch[id_col], batch[html_col], strict=True):
                for i, node in enumerate(n for n in tree(page or "").below() if is_entry(n)):
                    below = [*node.below()]
                    link = next((n for n in below if head(n) or anchor(n)), None)
                    text = next((n for n in below if caption(n) or para(n)), None)
                    if link is not None and i < most:
                        rows.append((key, i + 1, link.text().strip(), link.attrs.get("href", ""), text.text().strip() if text else ""))
            yield pd.DataFrame(rows, columns=[id_col, "rank", "title", "url", "snippet"])

    return _mapped(pages.select(id_col, html_col), run, f"{id_col} {kind}, rank int, title string, url string, snippet string")
