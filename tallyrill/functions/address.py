"""Postal codes and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrill.functions.text import strip

# Belgian code ranges and provinces, and the pattern of each country's codes.
PROVINCES_BE = [
    (1000, 1299, "Brussels-Capital Region"),
    (1300, 1499, "Walloon Brabant"),
    (1500, 1999, "Flemish Brabant"),
    (2000, 2999, "Antwerp"),
    (3000, 3499, "Flemish Brabant"),
    (3500, 3999, "Limburg"),
    (4000, 4999, "Liège"),
    (5000, 5999, "Namur"),
    (6000, 6599, "Hainaut"),
    (6600, 6999, "Luxembourg (BE)"),
    (7000, 7999, "Hainaut"),
    (8000, 8999, "West Flanders"),
    (9000, 9999, "East Flanders"),
]
POSTAL_PATTERNS = {
    "BE": r"^\d{4}$",
    "LU": r"^\d{4}$",
    "US": r"^\d{5}(-\d{4})?$",
    "DE": r"^\d{5}$",
    "FR": r"^\d{5}$",
    "NL": r"^\d{4}\s?[A-Z]{2}$",
    "GB": r"^[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}$",
}


def province_be(code: Column) -> Column:
    """The province of the digits of a code; empty where they are not four or in no range."""
    digits = F.regexp_replace(F.coalesce(code.cast("string"), F.lit("")), r"(?U)\D", "")
    number = F.when(F.length(digits) == 4, digits.try_cast("int"))
    out = F.when(number.isNull(), "")
    for low, high, name in PROVINCES_BE:
        out = out.when(number.between(low, high), name)
    return out.otherwise("")


def postal_valid(code: Column, country: Column) -> Column:
    """Whether the whole stripped text has the country's form; true for unknown countries."""
    text = F.coalesce(strip(code.cast("string")), F.lit("None"))
    out, chosen = None, F.upper(country)
    for cc, pattern in POSTAL_PATTERNS.items():
        test = text.rlike("(?iU)" + pattern)
        out = F.when(chosen == cc, test) if out is None else out.when(chosen == cc, test)
    return out.otherwise(True)


def _filled(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def format_address(street: Column, code: Column, city: Column, province: Column | None = None, country: Column | None = None) -> Column:
    """``street, code city, province, country`` without the empty parts; the country defaults to Belgium."""
    street = F.when(_filled(street).isNotNull(), F.regexp_replace(street, r"^[, ]+|[, ]+$", ""))
    line = F.nullif(F.concat_ws(" ", _filled(code), _filled(city)), F.lit(""))
    return F.concat_ws(", ", street, line, _filled(F.lit(None) if province is None else province), _filled(F.lit("Belgium") if country is None else country))
