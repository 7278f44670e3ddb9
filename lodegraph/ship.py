"""The package on executors that don't have it."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a context, unless they run on this
    machine and their Python path (that of the driver's start) holds it already."""
    context = spark.sparkContext
    here = context.master.startswith("local") and ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if here or getattr(context, "_lodegraph_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lodegraph-package-")
    archive = shutil.make_archive(os.path.join(folder, "lodegraph"), "zip", ROOT, "lodegraph")
    context.addPyFile(archive)
    context._lodegraph_shipped = True


def shipped(query: Callable) -> Callable:
    @wraps(query)
    def run(spark: SparkSession, *args):
        ship(spark)
        return query(spark, *args)

    return run
