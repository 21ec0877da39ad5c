"""Gives the executors this package, so that functions which are pickled by name are found there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's files to the session's Python files, once. A package that is in an archive was added by its user."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if getattr(sc, "_chronospark_shipped", False) or not os.path.isdir(root):
        return
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="package-")), "chronospark.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("chronospark", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._chronospark_shipped = True
