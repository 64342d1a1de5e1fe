"""HTTP by an injected transport: redirects within a cap, JSON bodies with raw fallback."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrill.functions.html import is_json

RESPONSE = "url string, final_url string, status int, headers map<string,string>, body string, error string"


def follow(url: str, transport: Callable[[str, dict], tuple[int, dict, str]], headers: dict, hops: int = 10) -> tuple:
    """(final URL, status, headers, body, error); status 0 and an error where the transport fails or redirects go on."""
    at = url
    try:
        for _ in range(hops + 1):
            status, got, body = transport(at, headers)
            to = {k.lower(): v for k, v in got.items()}.get("location")
            if not (300 <= status < 400 and to):
                return at, status, got, body, None
            at = urljoin(at, to)
        return at, 0, {}, None, f"more than {hops} redirects"
    except Exception as error:  # noqa: BLE001 - whatever the transport raises is a result
        return at, 0, {}, None, str(error)


def fetch(urls: DataFrame, transport: Callable[[str, dict], tuple[int, dict, str]], url_col: str = "url", headers: dict | None = None, partitions: int = 64, workers: int = 16, hops: int = 10) -> DataFrame:
    """A response for each distinct non-null URL; every task keeps ``workers`` requests in flight."""
    distinct = urls.select(F.col(url_col).alias("url")).where("url is not null").distinct().repartition(partitions, "url")

    def run(batches):
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                rows = [*pool.map(lambda u: (u, *follow(u, transport, headers or {}, hops)), batch["url"])]
                yield pd.DataFrame(rows, columns=["url", "final_url", "status", "headers", "body", "error"])

    return distinct.mapInPandas(run, RESPONSE)


def parsed_body(body: Column) -> Column:
    """``struct<json, raw>``: the body as JSON where it is JSON, else raw."""
    valid = is_json(body)
    return F.struct(F.when(valid, body).alias("json"), F.when(~valid, body).alias("raw"))
