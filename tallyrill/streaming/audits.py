"""Streams: the row-wise audits as they are, and keep-first within a watermark.

The reference semantics are those of a table; a stream gives the same rows as they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyrill.functions.text import is_blank
from tallyrill.operators.audit import encoding_findings, postal_invalid
from tallyrill.operators.tabular import _col, clean


def read_folder(spark: SparkSession, path: str, schema: StructType, format: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(format).load(path)


def findings(stream: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    return encoding_findings(stream, order, columns)


def invalid_postals(stream: DataFrame, order: str, code: str = "postal_code") -> DataFrame:
    return postal_invalid(stream, order, code)


def cleaned(stream: DataFrame, title_cols: list[str] | None = None) -> DataFrame:
    return clean(stream, title_cols=title_cols)


def keep_first(stream: DataFrame, keys: list[str], time_col: str, delay: str = "1 hour") -> DataFrame:
    """The first arrival of each key while its state lives; later copies within the watermark go."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def blank_rates(stream: DataFrame, columns: list[str], time_col: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Blank counts of the columns in windows of event time."""
    counts = [F.count_if(is_blank(_col(c).cast("string"))).alias(f"blank_{c}") for c in columns]
    return stream.withWatermark(time_col, delay).groupBy(F.window(time_col, window)).agg(F.count("*").alias("rows"), *counts)
