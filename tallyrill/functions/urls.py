"""URLs: the domain of a text, ports, resolution against a base."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrill.functions.text import strip


def url_domain(url: Column) -> Column:
    """The authority of a URL, with ``http://`` supplied where no (lower-case) scheme is; null for null or blank."""
    text = F.nullif(strip(url), F.lit(""))
    full = F.when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("http://"), text))
    authority = F.regexp_extract(full, r"^https?://([^/?#]*)", 1)
    path = F.regexp_extract(full, r"^https?://[^/?#]*([^?#]*)", 1)
    return F.when(text.isNotNull(), F.when(authority != "", authority).otherwise(F.split_part(path, F.lit("/"), F.lit(1))))


def without_port(domain: Column) -> Column:
    return F.split_part(domain, F.lit(":"), F.lit(1))


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, target: pd.Series) -> pd.Series:
    """A link's absolute URL; null where either is null."""
    return pd.Series([urljoin(b, t) if isinstance(b, str) and isinstance(t, str) else None for b, t in zip(base, target, strict=True)], dtype=object)


_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; what goes above the root stays at it."""
    parts = F.split(path, "/")

    def step(done: Column, part: Column) -> Column:
        return F.when(part == ".", done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(part)))

    rest = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, 1, 1), step)
    open_end = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.array_join(rest, "/"), F.when(open_end, "/").otherwise(""))


def resolved(base: Column, target: Column) -> Column:
    """A link's absolute URL after RFC 3986, section 5, without Python; null where either is null.  An empty link is the base itself."""
    part = lambda c, i: F.regexp_extract(c, _URL, i)
    has_host = target.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")
    base_path = F.when(part(base, 3) == "", "/").otherwise(part(base, 3))
    own = part(target, 3)
    merged = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_extract(base_path, r"^(.*/)?", 0), own))
    path = F.when(has_host, F.when(own == "", own).otherwise(_without_dots(own))).when(own == "", part(base, 3)).otherwise(_without_dots(merged))
    query = F.when((own == "") & ~has_host & ~target.rlike(r"^[^#]*\?"), part(base, 4)).otherwise(part(target, 4))
    host = F.when(has_host, part(target, 2)).otherwise(part(base, 2))
    built = F.concat(part(base, 1), F.lit("://"), host, path, query, part(target, 5))
    whole = F.concat(part(target, 1), F.lit("://"), part(target, 2), path, query, part(target, 5))
    absolute = part(target, 1) != ""
    return F.when(base.isNull() | target.isNull(), None).when(target == "", base).when(absolute & ~has_host, target).when(absolute, whole).otherwise(built)
