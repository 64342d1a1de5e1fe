"""What a session needs before the engine's Python parts run on executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context; needless where it is installed on every node."""
    context = spark.sparkContext
    if getattr(context, "_tallyrill_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="tallyrill-ship-"))  # only the driver reads it; Spark serves the file
    shutil.copytree(PACKAGE, folder / "package" / PACKAGE.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / "tallyrill"), "zip", folder / "package"))
    shutil.rmtree(folder / "package")
    context._tallyrill_shipped = True
