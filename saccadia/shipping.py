"""The package on the executors, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="saccadia-code-"), "saccadia.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(ROOT):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(ROOT)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
