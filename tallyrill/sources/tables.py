"""Table sources and sinks: CSV, workbooks, JSON records, and the row order they need."""

from __future__ import annotations

import json
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyrill.functions.text import na_to_null
from tallyrill.sources import xlsx

#: Places of a file's rows; the next file's rows follow after them.
FILE_SPAN = 1 << 40


def with_ordinal(df: DataFrame) -> DataFrame:
    """Adds ``_ord``, ascending in the order of reading; use a key of the data instead where there is one."""
    return df if "_ord" in df.columns else df.withColumn("_ord", F.monotonically_increasing_id())


def nulls(df: DataFrame) -> DataFrame:
    """Texts that a table reader takes for null become null."""
    return df.select(*(na_to_null(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in df.schema))


def blank_nulls(df: DataFrame) -> DataFrame:
    return df.na.fill("")


def read_table(spark: SparkSession, path: str, format: str | None = None, sheet: str | int = 0, infer: bool = False) -> DataFrame:
    """A CSV file or a workbook's sheet with ``_ord``, by suffix unless ``format`` says; all texts unless ``infer``."""
    kind = format or ("xlsx" if path.lower().endswith((".xlsx", ".xls", ".xlsm")) else "json" if path.lower().endswith(".json") else "csv")
    if kind == "json":
        return with_ordinal(read_records(spark, path))
    if kind == "csv":
        return with_ordinal(nulls(spark.read.csv(path, header=True, inferSchema=infer, multiLine=True, escape='"')))
    if "://" in path and not path.startswith("file://"):
        df = nulls(xlsx.read_workbooks(spark, path, sheet))
        return inferred(df) if infer else df
    xlsx.register(spark)
    reader = spark.read.format("xlsx").option("sheet", str(sheet)).option("sheetByName", "false" if isinstance(sheet, int) else "true")
    df = nulls(reader.load(path))
    return inferred(df) if infer else df


def inferred(df: DataFrame) -> DataFrame:
    """Text columns become numbers where every value is one."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    if not texts:
        return df
    bad = lambda c, t: F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull())
    got = df.agg(*(bad(c, t).alias(f"{t}_{i}") for i, c in enumerate(texts) for t in ("bigint", "double")), *(F.count(F.col(f"`{c}`")).alias(f"n_{i}") for i, c in enumerate(texts))).first()
    kind = {c: "bigint" if not got[f"bigint_{i}"] else "double" for i, c in enumerate(texts) if got[f"n_{i}"] and not got[f"double_{i}"]}
    return df.select(*(F.col(f"`{c}`").try_cast(kind[c]).alias(c) if c in kind else F.col(f"`{c}`") for c in df.columns))


def read_records(spark: SparkSession, source: str) -> DataFrame:
    """A JSON list of objects, from a path or as text; an empty list or anything else raises."""
    text = source.lstrip()
    if text.startswith(("[", "{")):
        parsed = json.loads(text)
        if not isinstance(parsed, list) or not parsed:
            raise ValueError("a non-empty JSON list of objects is needed")
        names = list(dict.fromkeys(k for row in parsed for k in row))
        kind = ", ".join(f"`{n}` string" for n in names)
        shown = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) if isinstance(v, dict | list) else str(v)
        return spark.createDataFrame([tuple(shown(row.get(n)) for n in names) for row in parsed], kind)
    df = spark.read.json(source, multiLine=True)
    if df.isEmpty():
        raise ValueError("a non-empty JSON list of objects is needed")
    return df


def _found(spark: SparkSession, path: str) -> tuple[object, object]:
    """A path's file system, as Spark opens it, and the path with its scheme."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.makeQualified(name)


def existing(paths: list[str], spark: SparkSession | None = None) -> tuple[list[str], list[str]]:
    """Paths that exist, on any file system that Spark opens, and those left out; none at all raises."""
    session = spark or SparkSession.active()
    here = [p for p in paths if (lambda found: found[0].exists(found[1]))(_found(session, p))]
    if not here:
        raise FileNotFoundError(f"none of {paths} exists")
    return here, [p for p in paths if p not in here]


def merge_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The union by name of the files that exist, in their order."""
    here, _ = existing(paths, spark)
    placed = [read_table(spark, p).transform(blank_nulls).withColumn("_ord", F.lit(i * FILE_SPAN) + F.col("_ord")) for i, p in enumerate(here)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed)


def write_csv(df: DataFrame, path: str, source: str | None = None, single: bool = False) -> None:
    """CSV with a header; writing over what is read, be it ``source`` or any file that ``df`` reads, raises."""
    spark = df.sparkSession
    out = _found(spark, path)[1].toString().rstrip("/")
    for name in [*([source] if source is not None else []), *df.inputFiles()]:
        read = _found(spark, unquote(name) if "%" in name else name)[1].toString().rstrip("/")
        if read == out or read.startswith(out + "/"):
            raise ValueError("the output must not be the path that is read")
    (df.coalesce(1) if single else df).drop("_ord").write.csv(path, header=True, mode="overwrite")


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, non-ASCII kept, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
