"""Makes this package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from procurespark.storage import is_local

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application.

    Only the workers of a local master share the driver's PYTHONPATH, so only they may have it already.
    """
    root = Path(__file__).resolve().parent.parent
    known = is_local(spark) and str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if known or spark.sparkContext.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="procurespark-")) / "procurespark.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted((root / "procurespark").rglob("*.py")):
            archive.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(spark.sparkContext.applicationId)
