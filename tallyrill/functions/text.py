"""Text rules shared by the operators: blanks, trimming, percent texts, detectors, similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The cell texts that a table reader takes for null, and the detectors' patterns.
NA_TOKENS = ["", "NA", "N/A", "n/a", "NULL", "null", "None", "NaN", "nan", "-NaN", "-nan", "<NA>", "#N/A", "#NA", "#N/A N/A", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN"]
MOJIBAKE = r"Ã.|Â.|â€.|ï¿½|\?\?|\x{FFFD}"
HTML_TAG = r"<[^>]+>|&[a-z]+;|&#\d+;"
MOJIBAKE_TYPE, HTML_TYPE = "Mojibake/Encoding Corruption", "Unstripped HTML Tag"


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def strip(c: Column) -> Column:
    """Trims Unicode white space, as a plain ``trim`` does not."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm(c: Column) -> Column:
    """Lower-cased and stripped."""
    return F.lower(strip(c))


def is_blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def pct_text(x: Column, digits: int = 1) -> Column:
    """``12.3%``, rounded half-even on the binary value, without thousands separators."""
    return F.concat(F.replace(F.format_number(x, digits), F.lit(","), F.lit("")), F.lit("%"))


def finding(c: Column) -> Column:
    """The kind of encoding finding of a cell, or null; mojibake wins over markup."""
    return F.when(c.rlike(MOJIBAKE), MOJIBAKE_TYPE).when(c.rlike(HTML_TAG), HTML_TYPE)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def first_line(c: Column) -> Column:
    return F.split_part(c, F.lit("\n"), F.lit(1))


def text_or(c: Column, default: str) -> Column:
    """Stripped text, or the default where nothing is left."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(default))


def breaks(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit("<br>"))


def long_date(c: Column) -> Column:
    """``7 March 2025``."""
    return F.date_format(c, "d MMMM yyyy")


def iso_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def uri_component(c: Column) -> Column:
    """Percent-encodes all but letters, digits and ``-_.!~*'()``."""
    out = F.url_encode(c)
    for shown, code in ((" ", None), ("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = F.replace(out, F.lit("+"), F.lit("%20")) if code is None else F.replace(out, F.lit(code), F.lit(shown))
    return out


def title_case(c: Column) -> Column:
    """Capital after everything that has no case, as ``initcap`` alone does not."""
    runs = F.regexp_extract_all(c, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two lower-cased, stripped texts; 0 where one is null. Order matters."""
    return pd.Series([SequenceMatcher(None, x.lower().strip(), y.lower().strip()).ratio() if isinstance(x, str) and isinstance(y, str) else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def page_ranges(spec: Column, total: Column) -> Column:
    """0-based pages of ``1,3-5``: distinct, sorted, within ``total``; all pages where the text is empty."""
    parts = F.transform(F.split(spec, ","), lambda p: F.regexp_replace(p, r"\s", ""))

    def span(p: Column) -> Column:
        lo = F.split_part(p, F.lit("-"), F.lit(1)).try_cast("int")
        hi = F.when(p.contains("-"), F.split_part(p, F.lit("-"), F.lit(2)).try_cast("int")).otherwise(lo)
        return F.when(lo <= hi, F.sequence(lo, F.least(hi, F.greatest(total, lo)))).otherwise(F.array().cast("array<int>"))

    listed = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, span))))
    everything = F.when(total > 0, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>"))
    chosen = F.when(F.coalesce(spec, F.lit("")) == "", everything).otherwise(F.filter(listed, lambda x: (x >= 1) & (x <= total)))
    return F.transform(chosen, lambda x: x - 1)


def column_list(text: str | None) -> list[str]:
    """``a, b`` as a list, without empty parts."""
    return [p.strip() for p in (text or "").split(",") if p.strip()]


def field_map(text: str) -> dict[str, str]:
    """``name:h3,phone:.tel`` as a map; of more than two parts between colons only the first two count."""
    pairs = (p.split(":") for p in text.split(","))
    return {p[0].strip(): p[1].strip() for p in pairs if len(p) > 1 and p[0] and p[1]}
