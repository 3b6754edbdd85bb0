"""This package on the executors, for operators whose tasks run its Python functions."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    with tempfile.NamedTemporaryFile(prefix=f"{root.name}-domain-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    atexit.register(Path(f.name).unlink, missing_ok=True)
    spark.sparkContext.addPyFile(f.name)
    _shipped.add(app)
