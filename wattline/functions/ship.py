"""Make this package importable on every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Zip the package once per application and hand it to Spark's file server.

    Grouped and mapped Python functions are pickled by reference, so executors must
    be able to import the package even where the repository is not on their path.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    if not root.is_dir():  # already running from the shipped archive
        return
    folder = tempfile.mkdtemp(prefix="wattline-")
    target = os.path.join(folder, "wattline_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(Path(root.name) / path.relative_to(root)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
