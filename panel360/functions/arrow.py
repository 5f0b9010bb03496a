"""Python functions over Arrow batches, with the code they need on every worker."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application: they need not share the driver's
    folders or its module path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    folder = Path(tempfile.mkdtemp(prefix="panel360-")).resolve()  # Spark serves the file from there
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent,
                                          package.name))
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """`mapInArrow` by a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
