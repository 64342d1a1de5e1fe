"""Data-quality audits: blank coverage, duplicate groups, encoding findings, postal codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrill.functions.address import postal_valid
from tallyrill.functions.text import finding, is_blank, pct_text, strip
from tallyrill.operators.tabular import _col


def blank_coverage(df: DataFrame) -> DataFrame:
    """``column_name, empty_rows, empty_share, empty_percentage`` of columns with blanks: one aggregate, then a row a column."""
    names = [c for c in df.columns if c != "_ord"]
    counts = df.agg(F.count("*").alias("_n"), *(F.count_if(is_blank(_col(c).cast("string"))).alias(f"b{i}") for i, c in enumerate(names)))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"b{i}").alias("empty_rows")) for i, c in enumerate(names))))
    share = F.col("empty_rows") / F.col("_n") * 100
    return counts.select("_n", cells.alias("c")).select("_n", "c.*").where("empty_rows > 0").select("column_name", "empty_rows", share.alias("empty_share"), pct_text(share).alias("empty_percentage"))


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share their keys with another, with ``group_rows``.

    Keys are counted with a combine before the shuffle and joined back, so that a key with
    very many rows is no single window.
    """
    groups = df.groupBy(*map(_col, keys)).agg(F.count("*").alias("group_rows")).where("group_rows > 1")
    renamed = groups.select(*(_col(k).alias(f"_g{i}") for i, k in enumerate(keys)), "group_rows")
    same = [_col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return df.join(renamed, condition).drop(*(f"_g{i}" for i in range(len(keys))))


def duplicate_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """``duplicate_rows`` (all members of groups) and ``unique_rows`` (the others)."""
    groups = df.groupBy(*map(_col, keys)).agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    dup = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    return groups.agg(dup.alias("duplicate_rows"), (total - dup).alias("unique_rows"))


def encoding_findings(df: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """``row_ord, column_name, value, type`` of every cell with mojibake, else markup."""
    names = columns or [c for c in df.columns if c != order]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.coalesce(_col(c).cast("string"), F.lit("")).alias("value")) for c in names)))
    long = df.select(_col(order).alias("row_ord"), cells.alias("c")).select("row_ord", "c.*")
    return long.withColumn("type", finding(F.col("value"))).where("type is not null")


def _bad_postal(code: str, country: str, checked: tuple[str, ...]) -> tuple[Column, Column]:
    """The stripped code, and whether it is non-blank without the country's form."""
    text = strip(F.coalesce(_col(code).cast("string"), F.lit("")))
    return text, (text != "") & ~postal_valid(text, F.lit(country)) if country.upper() in checked else F.lit(False)


def postal_invalid(df: DataFrame, order: str, code: str = "postal_code", country: str = "BE", checked: tuple[str, ...] = ("BE",)) -> DataFrame:
    """``row_ord, postal_code`` of non-blank codes without the country's form; countries not ``checked`` pass."""
    text, bad = _bad_postal(code, country, checked)
    return df.where(bad).select(_col(order).alias("row_ord"), text.alias("postal_code"))


def sample(df: DataFrame, order: list[str], most: int = 10) -> DataFrame:
    """The first rows of a report."""
    return df.orderBy(*order).limit(most)


def excel_row(order_col):
    """A sheet's row number of a 0-based place: the header is row 1."""
    return order_col + 2


def audit(df: DataFrame, keys: list[str], order: str, country: str = "BE", dataset: str = "", checked: tuple[str, ...] = ("BE",)) -> DataFrame:
    """The whole audit as one row: counts, coverage, duplicates, findings and their first ten.

    One aggregate makes all counts; the duplicates are a second one, by key, and each list of samples is a top ten.
    """
    keys = [k for k in keys if k in df.columns]
    names = [c for c in df.columns if c != order]
    blank = [F.count_if(is_blank(_col(c).cast("string"))).alias(f"_b{i}") for i, c in enumerate(names)]
    kinds = F.array(*(finding(F.coalesce(_col(c).cast("string"), F.lit(""))) for c in names)) if names else F.array().cast("array<string>")
    counts = [F.coalesce(F.sum(F.size(F.filter(kinds, lambda k: k.isNotNull()))), F.lit(0)).alias("encoding_issues_count")]
    lists = [("encoding_samples", encoding_findings(df, order), ["row_ord", "column_name"])] if names else []
    if "postal_code" in names:
        counts.append(F.count_if(_bad_postal("postal_code", country, checked)[1]).alias("invalid_postal_codes_count"))
        lists.append(("invalid_postal_samples", postal_invalid(df, order, country=country, checked=checked), ["row_ord"]))
    base = df.agg(F.count("*").alias("total_rows"), *blank, *counts)
    share = [pct_text(F.try_divide(F.col(f"_b{i}"), F.col("total_rows")) * 100) for i in range(len(names))]
    entries = F.array(*(F.struct(F.lit(c).alias("key"), F.struct(F.col(f"_b{i}").alias("empty_rows"), share[i].alias("empty_percentage")).alias("value")) for i, c in enumerate(names)))
    coverage = F.map_from_entries(F.array_sort(F.filter(entries, lambda e: e["value"]["empty_rows"] > 0))) if names else F.create_map()
    out = base.select(F.lit(dataset).alias("dataset"), "total_rows", F.lit(len(names)).alias("total_columns"), coverage.alias("null_coverage"), *base.columns[1 + len(names) :])
    if keys:  # one row by one row, here and below
        dup = duplicate_summary(df, keys).select(F.struct(F.array(*map(F.lit, keys)).alias("keys_checked"), "duplicate_rows", "unique_rows").alias("duplicates"))
        out = out.crossJoin(F.broadcast(dup))
    for name, rows, by in lists:
        out = out.crossJoin(F.broadcast(sample(rows, by).agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(name))))
    return out


def duplicate_flags(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with ``is_duplicate``; null is a key value.  Keys met more than once are counted and joined back."""
    groups = df.groupBy(*map(_col, keys)).agg(F.count("*").alias("_n")).where("_n > 1")
    renamed = groups.select(*(_col(k).alias(f"_g{i}") for i, k in enumerate(keys)), "_n")
    same = [_col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return df.join(renamed, condition, "left").withColumn("is_duplicate", F.col("_n").isNotNull()).drop("_n", *(f"_g{i}" for i in range(len(keys))))
