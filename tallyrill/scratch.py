"""Tables that cut lineage: written to the folder that the cluster shares, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting: the shuffle files of a query go when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent in a local session, as in tests, a temporary folder is made once per
    session and remembered in the session's settings; elsewhere that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tallyrill.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        found = "file://" + tempfile.mkdtemp(prefix="tallyrill-")
        spark.conf.set("tallyrill.shared.dir", found)
    return found.rstrip("/")


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tallyrill-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, group: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and the
    shuffle files of the write go with it.

    ``group``: bytes of a row group, for rows of megabytes.  Writers and readers hold a row group each; unless told otherwise, a
    writer looks at its size for the first time after 100 rows.

    The files live until :func:`discard`, :func:`clear` or the folder's own clean-up.
    """
    spark = df.sparkSession
    path = f"{_session_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        sizes = {} if group is None else {"parquet.block.size": group, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
        df.write.option("compression", "zstd").options(**sizes).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later step reads."""
    for t in tables:
        _delete(t.sparkSession, t.written_to)


def clear(spark: SparkSession) -> None:
    """Delete every table that this session has written with :func:`written`."""
    _delete(spark, _session_dir(spark))
