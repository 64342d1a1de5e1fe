from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrill.operators import audit, domains, entity, image_diff, severity, tabular, web
from tallyrill.plans import report
from tallyrill.sources import fetch, images, tables, xlsx


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


def test_merge_keep_first_null_differs_from_blank(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "", "k")], "_ord long, a string, b string")
    b = spark.createDataFrame([(3, "x"), (4, "y")], "_ord long, a string")
    merged = tabular.merge_tables([a, b])
    assert rows(merged, "_ord") == [(1, "x", ""), (2, "", "k"), (3, "x", None), (4, "y", None)]
    with pytest.warns(UserWarning):
        first = tabular.keep_first(merged, ["a", "nope"], "_ord")
    assert [r[0] for r in rows(first, "_ord")] == [1, 2, 4]
    both = tabular.keep_first(merged, ["a", "b"], "_ord")
    assert both.count() == 4 and tabular.keep_first(both, ["a", "b"], "_ord").count() == 4
    assert rows(tabular.dedup_statistics(merged, ["a"])) == [(4, 3, 1)]


@pytest.mark.parametrize(("spec", "want"), [("3", [0, 1, 2]), ("2-4", [1, 2, 3]), ("-5", list(range(6))), ("x", list(range(6))), (None, list(range(6))), ("4-2", [])])
def test_slice(spark, spec, want):
    df = spark.range(6)
    if spec in ("-5", "x"):
        with pytest.warns(UserWarning):
            got = tabular.slice_rows(df, spec, "id")
    else:
        got = tabular.slice_rows(df, spec, "id")
    assert sorted(r[0] for r in got.collect()) == want


def test_audit_parts(spark):
    df = spark.createDataFrame([(0, " ", "1000"), (1, None, "x1"), (2, "Ã©", ""), (3, "<b>", " 12 ")], "_ord long, a string, postal_code string")
    assert rows(audit.blank_coverage(df), "column_name") == [("a", 2, 50.0, "50.0%"), ("postal_code", 1, 25.0, "25.0%")]
    assert rows(audit.postal_invalid(df, "_ord"), "row_ord") == [(1, "x1"), (3, "12")]
    assert audit.postal_invalid(df, "_ord", country="US").count() == 0
    full = audit.audit(df, ["a", "zzz"], "_ord").first()
    assert full["total_rows"] == 4 and full["encoding_issues_count"] == 2 and full["duplicates"]["duplicate_rows"] == 0
    empty = audit.audit(df.limit(0), ["a"], "_ord").first()
    assert empty["total_rows"] == 0 and empty["duplicates"]["unique_rows"] == 0


def test_duplicates_add_up(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), (None, None), (None, None)], "k string, v string")
    dup, unique = rows(audit.duplicate_summary(df, ["k", "v"]))[0]
    assert (dup, unique) == (4, 1) and audit.duplicate_rows(df, ["k", "v"]).count() == 4


def test_flags_and_positions_in_ranges(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), (None, None), (None, None), ("c", None)], "k string, v string")
    assert sorted(r["is_duplicate"] for r in audit.duplicate_flags(df, ["k", "v"]).collect()) == [False] * 2 + [True] * 4
    rng = np.random.default_rng(3)
    data = [(["hot", "a", None, "z"][min(3, int(rng.geometric(0.6)) - 1)], int(i)) for i in rng.permutation(300)]
    df = spark.createDataFrame(data, "g string, i int").repartition(5)
    want = [r["i"] for r in df.orderBy("g", "i").collect()]
    for per_range in (1_000_000, 20, 1):
        got = tabular.positioned(df, ["g", "i"], per_range).orderBy("_position").collect()
        assert [r["_position"] for r in got] == list(range(1, 301)) and [r["i"] for r in got] == want
        assert per_range > 20 or len({r["_range"] for r in got}) > 5
        assert [r["i"] for r in tabular.slice_rows(df, "41-60", "i", per_range).orderBy("i").collect()] == list(range(40, 60))
    assert tabular.positioned(df.limit(0), ["g", "i"]).count() == 0
    assert [r["parity"] for r in report.section_rows(df, "h", ["g", "i"], 20).orderBy("position").collect()] == [0, 1] * 150


def test_fuzzy_pairs_in_one_large_block(spark):
    rng = np.random.default_rng(4)
    names = sorted({"".join(rng.choice(list("aabcde é"), int(rng.integers(1, 14)))) for _ in range(250)} | {"😀ab", "😁ab", "abba" * 60, "abba" * 59 + "abb"})
    df = spark.createDataFrame([(int(i), n) for i, n in zip(rng.permutation(len(names)), names, strict=True)], "_ord long, name string").repartition(3)
    by = {r["_ord"]: r["name"] for r in df.collect()}
    for threshold in (0.85, 0.6):
        got = {(r["ord_1"], r["ord_2"]): r["similarity"] for r in entity.fuzzy_pairs(df, "name", None, "_ord", threshold).collect()}
        want = {}
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                a, b = (by[k].lower().strip() for k in (i, j))
                if by[i] and by[j] and a != b and (r := SequenceMatcher(None, a, b).ratio()) >= threshold:
                    want[i, j] = r
        assert got == want and len(want) >= 5


def test_majority_rules(spark):
    data = [(0, "t", "x"), (1, "t", "y"), (2, "s", "x"), (3, "s", None), (4, "m", "a"), (5, "m", "b"), (6, "m", "b"), (7, "m", None), (8, "n", None), (9, None, "q")]
    df = spark.createDataFrame(data, "_ord long, g string, v string")
    best = {r[0]: r[1] for r in rows(entity.majority(df, "g", "v", "_ord"))}
    assert best == {"t": "x", "s": "x", "m": "b"}
    out = rows(entity.outliers(df, "g", "v", "_ord"), "row_ord")
    assert [(o[0], o[2], o[3], o[4]) for o in out] == [(1, "y", "x", "1/2 branches"), (4, "a", "b", "2/4 branches"), (7, None, "b", "2/4 branches")]
    fixed = entity.aligned(df, "g", "v", "_ord")
    assert fixed.count() == 10 and entity.outliers(fixed, "g", "v", "_ord").count() == 0


def test_fuzzy_pairs_against_difflib(spark):
    names = ["Tide Shop", "tide shop ", "Tied Shop", None, "Shop Tide", "Cafe Luna", "Cafe Lunna", "x"]
    df = spark.createDataFrame([(i, n, "c" if i != 4 else None) for i, n in enumerate(names)], "_ord long, name string, city string")
    got = {(r["ord_1"], r["ord_2"]): r["similarity"] for r in entity.fuzzy_pairs(df, "name", "city", "_ord", 0.8).collect()}
    want = {}
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            b = names[j]
            if a and b and 4 not in (i, j) and a.lower().strip() != b.lower().strip():
                r = SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio()
                if r >= 0.8:
                    want[i, j] = r
    assert got == want and want
    with pytest.raises(ValueError, match="no block"):
        entity.fuzzy_pairs(df, "name", None, "_ord", most_unblocked=2)


def test_brand_rules(spark):
    brands = ["Corrupted X", "Muster Bau AG", "Hochbau", "Hotel Q", "Big Bank of Bern", "Bank Bern", "Shop"]
    df = spark.createDataFrame([(i, b, "c", "http://a.ch/" if i == 6 else None, f"t{i}") for i, b in enumerate(brands)], "_ord long, franchise_name string, category string, website string, city string")
    got = {r["brand_name"]: (r["status"], r["domain_hint"], r["sample_website"]) for r in entity.brand_audit(df, "_ord").collect()}
    assert [got[b][0] for b in brands] == [entity.MISREPRESENTED, entity.MISREPRESENTED, entity.PRESENT, entity.REVIEW, entity.REVIEW, entity.PRESENT, entity.PRESENT]
    assert got["Shop"] == (entity.PRESENT, "Yes", "http://a.ch/") and got["Hochbau"][2] == "N/A"
    many = spark.createDataFrame([(i, "B", f"c{i % 5}") for i in range(10)], "_ord long, business_name string, city string")
    assert entity.brand_audit(many, "_ord").first()["sample_cities"] == "c0, c1, c2 (+2 more)"


def test_domains(spark):
    df = spark.createDataFrame([(1, "http://ok.com/x"), (2, "bad.com"), (3, None)], "i int, url string")
    results = domains.resolved(domains.distinct_domains(df, "url"), lambda d: (d.startswith("ok"), "m"), 2)
    assert rows(domains.summary(results)) == [(2, 1, "50.0%", 1)]
    assert [(r["i"], r["is_valid"], r["message"]) for r in domains.with_results(df, "url", results).orderBy("i").collect()] == [(1, True, "m"), (2, False, "m"), (3, False, "Empty domain")]


def test_fetch_redirects_and_failures(spark):
    def transport(url, headers):
        if url.endswith("/loop"):
            return 302, {"Location": "/loop"}, ""
        if url.endswith("/go"):
            return 301, {"location": "end"}, ""
        if url.endswith("/end"):
            return 200, {}, '{"a": 1}'
        raise OSError("down")

    df = spark.createDataFrame([("http://h/go",), ("http://h/loop",), ("http://h/x",), (None,)], "url string")
    got = {r["url"]: r for r in fetch.fetch(df, transport, partitions=2).withColumn("b", fetch.parsed_body(F.col("body"))).collect()}
    assert got["http://h/go"]["final_url"] == "http://h/end" and got["http://h/go"]["b"]["json"] == '{"a": 1}'
    assert got["http://h/loop"]["status"] == 0 and got["http://h/x"]["error"] == "down" and len(got) == 3


def test_selectors_and_forms(spark):
    page = '<div class="card big" id="c1"><h3>A</h3><p class="tel">1</p></div><div class=card><h3>B</h3></div><form action="/s"><input name=q required><select name=z></select></form>'
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert rows(web.select_records(df, "div.card", {"name": "h3", "tel": ".tel"}), "position") == [(1, 0, "A", "1"), (1, 1, "B", "")]
    assert rows(web.select_records(df, "#c1")) == [(1, 0, "A1")]
    form = web.page_forms(df).first()
    assert (form["action"], form["method"], [f["type"] for f in form["fields"]], form["fields"][0]["required"]) == ("/s", "get", ["text", "select-one"], True)
    with pytest.raises(ValueError, match="not supported"):
        web.matcher("div:hover")


def test_link_summary_and_hits(spark):
    df = spark.createDataFrame([(1, 0, 200), (1, 1, 404), (1, 2, 0), (1, 3, 500)], "page_id int, position int, status int")
    r = web.link_summary(df, "page_id", 3).first()
    assert (r["total"], r["checked"], r["broken"], len(r["details"])) == (4, 3, 2, 3)
    hits = spark.createDataFrame([("q", 0, "T", "http://engine/x", None), ("q", 1, " ", "http://a", "s"), ("q", 2, "t", "ftp://b", "s"), ("q", 3, "t", "http://c", "s")], "query string, position int, title string, url string, snippet string")
    assert [(r["rank"], r["title"]) for r in web.rank_hits(hits, "query", "position", 3, ("engine",)).collect()] == [(1, "(no title)")]
    assert [r["rank"] for r in web.rank_hits(hits, "query", "position", 4, ("engine",), dense=False).orderBy("rank").collect()] == [2, 4]


def test_severity(spark):
    df = spark.createDataFrame([("r", i, f"first {i}\nrest") for i in range(5)], "rule string, i int, t string")
    assert rows(severity.first_nodes(df, "rule", "i", "t")) == [("r", 5, ["first 0", "first 1", "first 2"], "... and 2 more")]


@pytest.mark.parametrize("change", [0, 1, 40])
def test_images(spark, change):
    a = np.full((20, 30, 4), 255, np.uint8)
    b = np.full((22, 28, 4), 255, np.uint8)
    b.reshape(-1, 4)[:change, :3] = 0
    df = spark.createDataFrame([(1, bytearray(images.encode_png(a)), bytearray(images.encode_png(b)))], "id int, x binary, y binary")
    r = image_diff.image_diff(df, "id", "x", "y", with_image=True).first()
    assert (r["width"], r["height"], r["different_pixels"]) == (28, 20, change)
    assert r["band"] == {0: "identical", 1: "minor", 40: "significant"}[change]
    assert images.decode_png(bytes(r["diff"])).shape == (20, 28, 4)


def test_workbook_round_trip(spark, tmp_path):
    data = [("a", "<&>\"é", None), ("b", "", "2"), ("c", "NA", "3")]
    df = spark.createDataFrame(data, "k string, v string, n string").coalesce(1)
    path = str(tmp_path / "t.xlsx")
    xlsx.write_xlsx(df, path, "Sheet A")
    back = tables.read_table(spark, path, sheet="Sheet A")
    assert rows(back, "_ord") == [("a", "<&>\"é", None, 0), ("b", None, "2", 1), ("c", None, "3", 2)]
    assert dict(tables.inferred(back).dtypes)["n"] == "bigint"
    for sheet in ("Sheet A", 0):
        assert rows(tables.nulls(xlsx.read_workbooks(spark, path, sheet)), "_ord") == rows(back, "_ord")
    with pytest.raises(Exception, match="no sheet"):
        tables.read_table(spark, path, sheet="nope").collect()


def test_brand_workbook_and_png_folder(spark, tmp_path):
    brands = [("A", "c", 1200, "Yes", "Manual Review", "http://a.ch", "r", "x"), ("B", "c", 34, "No", "Verified Present", "N/A", "r", "y")]
    df = spark.createDataFrame(brands, "brand_name string, category string, branch_count long, domain_hint string, status string, sample_website string, reason string, action_required string").coalesce(1)
    path = str(tmp_path / "b.xlsx")
    xlsx.write_brand_workbook(df.select("status", *[c for c in df.columns if c != "status"]), path, "CH", "me", "base.xlsx")
    with open(path, "rb") as f:
        got = [*xlsx.sheet_rows(f.read())]
    assert got[0] == ["CH Franchise Brand Existence & Misrepresentation Audit"] and got[1] == ["Dataset: base.xlsx | Auditor: me | Total Brands: 2 | Total Rows: 1,234"]
    assert got[3] == ["Brand Name", "Category", "Branch Count", "Domain Hint (.ch)", "Status", "Sample Website", "Evidence / Issue Reason", "Action Required"]
    assert got[4] == [str(v) for v in brands[0]] and got[5][0] == "B"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.png").write_bytes(images.encode_png(np.zeros((2, 3, 4), np.uint8)))
    r = images.read_png(spark, str(tmp_path / "p")).first()
    assert (r["width"], r["height"], len(r["pixels"])) == (3, 2, 24)


def test_csv_records_and_missing_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('x,y\n1,"a ""q""\nline"\nNA,-\n')
    got = tables.read_table(spark, str(p))
    assert [r[:2] for r in rows(got, "_ord")] == [("1", 'a "q"\nline'), (None, "-")]
    assert tables.merge_files(spark, [str(p), str(tmp_path / "none.csv"), str(p)]).count() == 4
    with pytest.raises(FileNotFoundError):
        tables.existing([str(tmp_path / "none")])
    assert rows(tables.read_records(spark, '[{"a": 1, "b": [1]}, {"a": null, "c": "x"}]')) == [("1", "[1]", None), (None, None, "x")]
    with pytest.raises(ValueError):
        tables.read_records(spark, "[]")
    with pytest.raises(ValueError, match="must not be"):
        tables.write_csv(got, str(p), source=str(p))
    tables.write_csv(got, str(tmp_path / "out"), single=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True, multiLine=True).count() == 2


def test_report_shapes():
    assert report.build_sections() == [{"heading": "Report", "body": report.EMPTY}]
    assert report.build_sections([{"a": 1}])[0]["type"] == "table"
    assert report.build_sections({"sections": [{"heading": "h"}]}) == [{"heading": "h"}]
    assert report.build_sections('{"k": {"x": 1}}')[0]["type"] == "key-value"
    page = report.render_html(report.build_sections([{"a": "PASS", "b": "<x>"}, {"a": None, "c": "no"}]), "T", "me", "today")
    assert "✅ PASS" in page and "&lt;x&gt;" in page and "❌ no" in page and "undefined" not in page
    assert "<br>" in report.render_section({"body": "a\nb"})
    assert list(report.THEMES) == ["dark", "light", "blue", "green"]
    for name, theme in report.THEMES.items():
        page = report.render_html(report.build_sections([{"a": "ok"}]), "T", "me", "today", name)
        assert theme["bg"] in page and theme["success"] in page


def test_links_bare_and_absolute(spark):
    page = """<BASE href='/root/'><a href=x/y>One</a> <a class=b href='../z'>Two</a><a href="//o.example">T</a><a name=n>no</a><a data-x=1 HREF = "#s">S</a>"""
    df = spark.createDataFrame([(1, page, "https://h.example/a/b"), (2, "<a href=q>Q</a>", "http://i.example/p/?x"), (3, None, "http://j.example/"), (4, "<a href=q>Q</a>", None)], "page_id long, html string, url string")
    got = rows(web.page_urls(df), "page_id", "position")
    assert [(r[0], r[3], r[4]) for r in got] == [
        (1, "x/y", "https://h.example/root/x/y"), (1, "../z", "https://h.example/z"), (1, "//o.example", "https://o.example"), (1, "#s", "https://h.example/root/#s"),
        (2, "q", "http://i.example/p/q"), (4, "q", None),
    ]


def test_a_sink_never_overwrites_what_is_read(spark, tmp_path):
    path = str(tmp_path / "with space")
    spark.range(5).write.csv(path, header=True)
    df = spark.read.csv(path, header=True)
    for out in (path, f"file://{path}/", str(tmp_path)):
        with pytest.raises(ValueError, match="must not be"):
            tables.write_csv(df, out)
    tables.write_csv(df, str(tmp_path / "other"))
    assert spark.read.csv(path, header=True).count() == 5 == spark.read.csv(str(tmp_path / "other"), header=True).count()
    assert tables.existing([f"file://{path}", path, str(tmp_path / "none")], spark) == ([f"file://{path}", path], [str(tmp_path / "none")])
