"""Sends this package to Python workers that cannot import it themselves."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the job once per application, by Spark's own file server.

    The archive is read by the driver alone.
    """
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        package = Path(__file__).resolve().parent.parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}_code", "zip",
                                      package.parent, package.name)
        context.addPyFile(archive)
        _SENT.add(context.applicationId)
