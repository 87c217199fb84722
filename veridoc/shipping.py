"""Sends the package to the executors, for clusters whose Python workers don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()
_archive: str | None = None


def ship(spark: SparkSession) -> None:
    """Add the package as a Python file, once for each application."""
    global _archive
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    if _archive is None:
        here = os.path.dirname(os.path.abspath(__file__))
        _archive = os.path.join(tempfile.mkdtemp(prefix="veridoc-"), "veridoc.zip")
        with zipfile.ZipFile(_archive, "w") as file:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        file.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(_archive)
    _sent.add(context.applicationId)
