"""Makes the package importable in Python workers that were not started with it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package's modules to the executors, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="riverloom-")) / "riverloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    _DONE.add(context.applicationId)
