"""Sends this package's Python code to the executors of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files, once; workers then import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        handle, path = tempfile.mkstemp(prefix="tidewave-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name, p.relative_to(root)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark
