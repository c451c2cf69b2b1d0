"""Python workers get the package with the session, wherever the driver was started."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import bilatera

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to all workers, once per application. The archive is served by the driver itself."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(bilatera.__file__))
    folder = tempfile.mkdtemp(prefix="spark-package-")
    copy = os.path.join(folder, "tree")
    shutil.copytree(home, os.path.join(copy, "bilatera"), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "bilatera"), "zip", copy))
    _SHIPPED.add(context.applicationId)
