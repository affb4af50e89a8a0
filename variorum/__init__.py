"""A PySpark engine for collating parallel versions of texts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable by the Python workers of every executor, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="variorum-")) / "variorum.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, f"variorum/{source.relative_to(root)}")
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
