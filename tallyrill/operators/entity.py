"""Entity conformance: fuzzy pairs within blocks, majority values, brand screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrill.functions.text import norm, pct_text, seq_ratio, strip
from tallyrill.operators.tabular import _col


# --- fuzzy pairs --------------------------------------------------------------------------


def _named(df: DataFrame, name: str, block: str | None, order: str) -> DataFrame:
    """``_ord, name, block``; null names and null blocks take no part."""
    key = F.lit("All") if block is None else _col(block)
    return df.select(_col(order).alias("_ord"), _col(name).cast("string").alias("name"), key.alias("block")).where("name is not null and block is not null")


def _spelled(rows: DataFrame) -> DataFrame:
    """``block, name, n, lo, hi, members``: each name of a block once, so that its normal form is made once and not a row.

    It hangs on the count, so that no filter of it moves below the grouping.
    """
    return rows.groupBy("block", "name").agg(F.min("_ord").alias("lo"), F.max("_ord").alias("hi"), F.count("*").alias("members")).withColumn("n", F.when(F.col("members") > 0, norm(F.col("name"))))


def _classes(rows: DataFrame) -> DataFrame:
    """``block, n, lo, hi, members, name``: the normal forms of a block, with the name of the first row."""
    return _spelled(rows).groupBy("block", "n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("members").alias("members"), F.min_by("name", "lo").alias("name"))


def fuzzy_candidates(df: DataFrame, name: str, block: str | None, order: str, threshold: float = 0.85) -> DataFrame:
    """``block, first, second``: ordered pairs of distinct normal forms in a block that could reach the threshold.

    A similarity is at most twice the shorter length over both lengths, so lengths alone
    rule pairs out, in the join.  Only distinct names are paired, not rows: a pair of names
    that fill a block is scored once, in the orders that occur (some row with the first name
    before some row with the second).  All names of a block meet; :func:`possible_pairs` spares them that.
    """
    names = _classes(_named(df, name, block, order)).withColumn("size", F.length("n"))
    a, b = names.alias("a"), names.alias("b")
    reach = 2 * F.least(F.col("a.size"), F.col("b.size")) >= threshold * (F.col("a.size") + F.col("b.size"))
    on = (F.col("a.block") == F.col("b.block")) & (F.col("a.n") != F.col("b.n")) & (F.col("a.lo") < F.col("b.hi")) & reach
    return a.join(b, on).select(F.col("a.block").alias("block"), F.col("a.n").alias("first"), F.col("b.n").alias("second"))


def possible_pairs(df: DataFrame, name: str, block: str | None, order: str, threshold: float = 0.85) -> DataFrame:
    """Those of the :func:`fuzzy_candidates` whose letters allow the threshold, found without comparing all names of a block.

    A similarity is twice the matching characters over both lengths, and no more characters match than
    the two names share.  A name's characters, numbered by occurrence, are a set of tokens, and a name of
    size ``s`` shares at least ``threshold * s / (2 - threshold)`` of them with any partner; so of the tokens beyond
    that, the rarest, two partners have one in common.  Names meet by block and such a token, which
    deals a block of any size over its tokens; then the whole sets are compared.
    """
    names = _classes(_named(df, name, block, order)).drop("name", "members").where("n <> ''")
    letters = F.split("n", "")
    numbered = F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c)).cast("string")))
    names = names.withColumn("tokens", numbered).withColumn("size", F.size("tokens"))
    each = names.select("block", "n", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("often"))
    ranked = each.join(often, "token").groupBy("block", "n").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("ranked"))
    sized = F.size("ranked")
    shared = F.ceil(sized * threshold / (2 - threshold) - 1e-9).cast("int")
    rare = ranked.select("block", "n", F.explode(F.slice("ranked", F.lit(1), F.greatest(sized - shared + 1, F.lit(1)))).alias("r")).select("block", "n", "r.token")
    keyed = rare.join(names, ["block", "n"])
    a, b = keyed.alias("a"), keyed.alias("b")
    size = F.col("a.size") + F.col("b.size")
    on = (F.col("a.block") == F.col("b.block")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.n") != F.col("b.n")) & (F.col("a.lo") < F.col("b.hi")) & (2 * F.least("a.size", "b.size") >= threshold * size)
    near = a.join(b, on).where(2 * F.size(F.array_intersect("a.tokens", "b.tokens")) >= threshold * size)
    return near.select(F.col("a.block").alias("block"), F.col("a.n").alias("first"), F.col("b.n").alias("second")).distinct()


def _similar(df: DataFrame, name: str, block: str | None, order: str, threshold: float) -> DataFrame:
    """``block, first, second, similarity``: those of the :func:`possible_pairs` that reach the threshold."""
    pairs = possible_pairs(df, name, block, order, threshold)
    scored = pairs.select("first", "second").distinct().withColumn("similarity", seq_ratio("first", "second")).where(F.col("similarity") >= threshold)
    return pairs.join(scored, ["first", "second"])


def _bounded(rows: DataFrame, block: str | None, most_unblocked: int | None) -> None:
    if block is None and most_unblocked is not None and rows.select("name").distinct().select(norm(F.col("name"))).distinct().limit(most_unblocked + 1).count() > most_unblocked:
        raise ValueError(f"more than {most_unblocked} names and no block to compare them in")


def _paired(a: DataFrame, good: DataFrame, b: DataFrame) -> DataFrame:
    """Row pairs of ``a`` and ``b`` in row order, where their names are a pair of ``good``."""
    a, b = (rows.withColumn("n", norm(F.col("name"))).alias(side) for rows, side in ((a, "a"), (b, "b")))
    joined = good.join(a, (F.col("a.block") == good["block"]) & (F.col("a.n") == good["first"])).join(b, (F.col("b.block") == good["block"]) & (F.col("b.n") == good["second"]) & (F.col("a._ord") < F.col("b._ord")))
    return joined.select(F.col("a._ord").alias("ord_1"), F.col("a.name").alias("name_1"), F.col("b._ord").alias("ord_2"), F.col("b.name").alias("name_2"), good["block"], "similarity", pct_text(F.col("similarity") * 100).alias("similarity_score"))


def fuzzy_pairs(df: DataFrame, name: str, block: str | None, order: str, threshold: float = 0.85, most_unblocked: int | None = None) -> DataFrame:
    """``ord_1, name_1, ord_2, name_2, block, similarity, similarity_score`` of row pairs in a block, in row order,
    whose names differ but are similar. The measure depends on the order of its arguments.

    Without a block all rows are one; where ``most_unblocked`` is given, more distinct names than that raise then.
    Names on many rows make the square of that many pairs: :func:`fuzzy_links` and :func:`fuzzy_members` say the same without them.
    """
    rows = _named(df, name, block, order)
    _bounded(rows, block, most_unblocked)
    return _paired(rows, _similar(df, name, block, order, threshold), rows)


def fuzzy_members(df: DataFrame, name: str, block: str | None, order: str) -> DataFrame:
    """``ord, name, block, class``: of each row with a name and a block, the first row of its block with the same normal form."""
    rows = _named(df, name, block, order)
    of = _spelled(rows).select("block", "name", "n").join(_classes(rows).select("block", "n", F.col("lo").alias("class")), ["block", "n"])
    return rows.join(of, ["block", "name"]).select(F.col("_ord").alias("ord"), "name", "block", "class")


def fuzzy_links(df: DataFrame, name: str, block: str | None, order: str, threshold: float = 0.85, most_unblocked: int | None = None) -> DataFrame:
    """``class_1, name_1, members_1, class_2, name_2, members_2, block, similarity, similarity_score``: the :func:`fuzzy_pairs` between classes of :func:`fuzzy_members`.

    A row of the first class and a later row of the second are a fuzzy pair, and there are no others; a pair of classes is
    there where such rows are, so in both orders where both have them and are similar.  Names are those of the classes' first rows.
    """
    rows = _named(df, name, block, order)
    _bounded(rows, block, most_unblocked)
    classes = _classes(rows).withColumnRenamed("lo", "class")
    side = lambda i, n: classes.select("block", F.col("n").alias(n), *(F.col(c).alias(f"{c}_{i}") for c in ("class", "name", "members")))
    joined = _similar(df, name, block, order, threshold).join(side(1, "first"), ["block", "first"]).join(side(2, "second"), ["block", "second"])
    return joined.select("class_1", "name_1", "members_1", "class_2", "name_2", "members_2", "block", "similarity", pct_text(F.col("similarity") * 100).alias("similarity_score"))


def first_fuzzy_pairs(df: DataFrame, name: str, block: str | None, order: str, n: int, threshold: float = 0.85) -> DataFrame:
    """The first ``n`` of the :func:`fuzzy_pairs` by block and the order of both rows, which tells rows of a block apart.

    A row has a later partner if it is before the last row of a similar name, so the first ``n`` such rows are found
    without pairs; they have ``n`` pairs at least, and only theirs are made.
    """
    rows, good = _named(df, name, block, order), _similar(df, name, block, order, threshold)
    spelled, last = _spelled(rows).select("block", "name", "n"), _classes(rows).select("block", F.col("n").alias("second"), F.col("hi").alias("last"))
    until = good.join(last, ["block", "second"]).groupBy("block", F.col("first").alias("n")).agg(F.max("last").alias("last")).join(spelled, ["block", "n"])
    heads = rows.join(until, ["block", "name"]).where("_ord < last").select(*rows.columns).orderBy("block", "_ord").limit(n)
    wanted = good.join(F.broadcast(heads.select("block", norm(F.col("name")).alias("first")).distinct()), ["block", "first"])
    later = rows.join(spelled.join(wanted.select("block", F.col("second").alias("n")).distinct(), ["block", "n"]).select("block", "name"), ["block", "name"])
    return _paired(F.broadcast(heads), wanted, later).orderBy("block", "ord_1", "ord_2").limit(n)


# --- majority -----------------------------------------------------------------------------


def majority(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """``group, majority, votes, members, distinct_values`` of non-null groups with a value; ties go to the value seen first.

    Values are counted first, so a window only sees a group's distinct values.
    """
    counts = df.where(_col(group).isNotNull()).groupBy(_col(group).alias("group"), _col(value).alias("value")).agg(F.count("*").alias("n"), F.min(_col(order)).alias("first"))
    votes = F.when(F.col("value").isNotNull(), F.struct(F.col("n").alias("n"), (-F.col("first")).alias("f"), F.col("value").alias("v")))
    best = counts.groupBy("group").agg(F.max(votes).alias("best"), F.sum("n").alias("members"), F.count("value").alias("distinct_values"))
    return best.where("best is not null").select("group", F.col("best.v").alias("majority"), F.col("best.n").alias("votes"), "members", "distinct_values")


def _beside(df: DataFrame, group: str, value: str, order: str) -> tuple[DataFrame, Column]:
    best = majority(df, group, value, order).where("distinct_values > 1")
    joined = df.join(best, _col(group) == F.col("group"), "left")
    return joined, F.col("group").isNotNull() & ~_col(value).eqNullSafe(F.col("majority"))


def outliers(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Rows whose value is not their group's majority (null is not), where a group has several values."""
    joined, out = _beside(df, group, value, order)
    share = F.concat(F.col("votes").cast("string"), F.lit("/"), F.col("members").cast("string"), F.lit(" branches"))
    return joined.where(out).select(_col(order).alias("row_ord"), _col(group).alias("franchise_name"), _col(value).alias("current_subcategory"), F.col("majority").alias("expected_majority_subcategory"), share.alias("majority_share"))


def aligned(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """All rows, outliers given their group's majority."""
    joined, out = _beside(df, group, value, order)
    return joined.select(*((F.when(out, F.col("majority")).otherwise(_col(c)).alias(c) if c == value else _col(c)) for c in df.columns))


def groups_audited(df: DataFrame, group: str) -> DataFrame:
    return df.agg(F.count_distinct(_col(group)).alias("groups_audited"))


# --- brands -------------------------------------------------------------------------------

# The screening's words and its texts.
EDIT_NOTES = ["update the postal code", "add street number", "corrupted"]
B2B = r"(?i)\b(ingenieure|architektur|consulting|holding|bau|berater|contractor|construction)\b"
HOTELS = ["hotel", "ibis", "radisson"]
MISREPRESENTED, REVIEW, PRESENT = "Misrepresentation", "Manual Review", "Verified Present"
NOTE_REASON, NOTE_ACTION = "Corrupted brand string containing supervisor edit instruction.", "REMOVE / MERGE — Clean and merge under canonical brand name."
B2B_REASON, B2B_ACTION = "Industrial construction, B2B engineering, or architectural firm with no retail store chain.", "REMOVE / RECLASSIFY — B2B entity, not a consumer retail franchise."
HOTEL_REASON, HOTEL_ACTION = "Hotel chain property. Verify subcategory taxonomy alignment to 'Hotels & Accommodations'.", "ALIGN TAXONOMY — Confirm subcategory matches 'Hotels & Accommodations'."
BANK_REASON, BANK_ACTION = "Brand name contains regional canton/city suffix. Clean location suffix.", "STRIP LOCATION SUFFIX — Clean franchise_name to pure brand name."


def brand_columns(names: list[str]) -> dict[str, str | None]:
    """Which columns hold brand, website, city and category, by preference; a column that is not there is None."""
    first = lambda wanted: next((w for w in wanted if w in names), None)
    return {"brand": first(["franchise_name", "business_name"]) or names[0], "website": first(["website", "url"]), "city": first(["city", "admin_level_1"]), "category": first(["category"]) or (names[1] if len(names) > 1 else None)}


def classified(brand: Column, country: str) -> Column:
    """``struct<status, reason, action_required>`` by the first rule that holds."""
    low = F.lower(brand)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    verdict = lambda s, r, a: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"), F.lit(a).alias("action_required"))
    return (
        F.when(any_of(EDIT_NOTES), verdict(MISREPRESENTED, NOTE_REASON, NOTE_ACTION))
        .when(brand.rlike(B2B), verdict(MISREPRESENTED, B2B_REASON, B2B_ACTION))
        .when(any_of(HOTELS), verdict(REVIEW, HOTEL_REASON, HOTEL_ACTION))
        .when(F.contains(low, F.lit("bank")) & (F.size(F.split(strip(brand), r"(?U)\s+")) > 3), verdict(REVIEW, BANK_REASON, BANK_ACTION))
        .otherwise(verdict(PRESENT, f"Active franchise brand verified operating in {country}.", "VERIFIED"))
    )


def brand_audit(df: DataFrame, order: str, country: str = "CH", columns: dict[str, str | None] | None = None, strict_tld: bool = False) -> DataFrame:
    """A row for each non-null brand: branches, first website and cities, local domain, status.

    Distinct websites and cities come from counts by (brand, value), so a brand with very many
    rows is combined before the shuffle; of a brand's cities only the first three are kept.
    """
    at = columns or brand_columns([c for c in df.columns if c != order])
    pickd = lambda k: _col(at[k]) if at[k] else F.lit(None).cast("string")
    rows = df.select(_col(order).alias("_ord"), pickd("brand").cast("string").alias("brand"), pickd("website").cast("string").alias("website"), pickd("city").cast("string").alias("city"), pickd("category").cast("string").alias("category")).where("brand is not null")
    tld = f".{country.lower()}"
    local = F.col("website").rlike(rf"(?i)^(?:https?://)?[^/?#]*\.{country}(?:[:/?#]|$)") if strict_tld else F.contains(F.lower("website"), F.lit(tld))
    real = strip(F.col("website")) != ""
    base = rows.groupBy("brand").agg(
        F.count("*").alias("branch_count"),
        F.min_by("category", F.when(F.col("category").isNotNull(), F.col("_ord"))).alias("category"),
        F.min_by("website", F.when(real, F.col("_ord"))).alias("website"),
        F.coalesce(F.bool_or(F.when(real, local)), F.lit(False)).alias("local"),
    )
    cities = rows.where("city is not null").groupBy("brand", "city").agg(F.min("_ord").alias("first"))
    first = cities.withColumn("_r", F.row_number().over(Window.partitionBy("brand").orderBy("first"))).where("_r <= 3")  # cut before the shuffle
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_r", "city"))), lambda x: x["city"])
    cities = first.groupBy("brand").agg(listed.alias("cities")).join(cities.groupBy("brand").agg(F.count("*").alias("n_cities")), "brand")
    more = F.when(F.col("n_cities") > 3, F.concat(F.lit(" (+"), (F.col("n_cities") - 3).cast("string"), F.lit(" more)"))).otherwise("")
    out = base.join(cities, "brand", "left").withColumn("v", classified(strip(F.col("brand")), country))
    return out.select(
        strip(F.col("brand")).alias("brand_name"), F.coalesce("category", F.lit("General")).alias("category"), "branch_count", F.col("v.status").alias("status"), F.coalesce("website", F.lit("N/A")).alias("sample_website"),
        F.coalesce(F.concat(F.array_join("cities", ", "), more), F.lit("")).alias("sample_cities"), F.when(F.col("local"), "Yes").otherwise("No").alias("domain_hint"), F.col("v.reason").alias("reason"), F.col("v.action_required").alias("action_required"),
    )


def brand_sorted(audit: DataFrame) -> DataFrame:
    """By status, then branches descending, then name."""
    return audit.orderBy("status", F.desc("branch_count"), "brand_name")
