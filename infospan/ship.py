"""Sends this package's source to a session's Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="infospan-")) / "infospan_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"infospan/{path.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _SENT.add(app)
