"""Domains of a table's URLs, looked up once each by an injected resolver."""

from __future__ import annotations

import socket
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrill.functions.text import pct_text
from tallyrill.functions.urls import url_domain


def distinct_domains(df: DataFrame, url_col: str) -> DataFrame:
    return df.select(url_domain(F.col(url_col)).alias("domain")).where("domain is not null and domain <> ''").distinct()


def dns(domain: str) -> tuple[bool, str]:
    """Live look-up; the part before the first colon."""
    try:
        socket.getaddrinfo(domain.split(":")[0], 80)
        return True, "Resolved"
    except socket.gaierror as error:
        return False, f"DNS Error: {error}"
    except Exception as error:  # noqa: BLE001 - any failure is a result
        return False, f"Error: {error}"


def resolved(domains: DataFrame, resolver: Callable[[str], tuple[bool, str]] = dns, partitions: int = 64, workers: int = 50) -> DataFrame:
    """``domain, is_valid, message``: each task keeps ``workers`` look-ups in flight."""

    def run(batches):
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                found = [*pool.map(resolver, batch["domain"])]
                yield pd.DataFrame({"domain": batch["domain"], "is_valid": [f[0] for f in found], "message": [f[1] for f in found]})

    return domains.repartition(partitions, "domain").mapInPandas(run, "domain string, is_valid boolean, message string")


def with_results(df: DataFrame, url_col: str, results: DataFrame) -> DataFrame:
    """The rows with their domain's result; rows without a domain are invalid with ``Empty domain``."""
    joined = df.withColumn("domain", url_domain(F.col(url_col))).join(results, "domain", "left")
    return joined.withColumn("is_valid", F.coalesce("is_valid", F.lit(False))).withColumn("message", F.coalesce("message", F.lit("Empty domain")))


def summary(results: DataFrame) -> DataFrame:
    """``tested, valid, valid_percentage, failed`` over the distinct domains."""
    counts = results.agg(F.count("*").alias("tested"), F.count_if("is_valid").alias("valid"))
    return counts.select("tested", "valid", F.when(F.col("tested") > 0, pct_text(F.col("valid") / F.col("tested") * 100)).otherwise("0").alias("valid_percentage"), (F.col("tested") - F.col("valid")).alias("failed"))


def failed_sample(results: DataFrame, most: int = 10) -> DataFrame:
    return results.where("not is_valid").orderBy("domain").limit(most).select("domain", "message")
