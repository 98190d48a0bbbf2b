"""Gives the executors this package, for functions that run in Python workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: the package goes out as a zip file, so executors need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        folder = Path(tempfile.mkdtemp())
        shutil.copytree(package, folder / "src" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "src"))
        shutil.rmtree(folder / "src")
        _shipped.add(app)
