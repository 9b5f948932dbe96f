"""Making this package known to the Python workers of a running session."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application; wherever the driver was started, the
    workers then find the functions that plans refer to."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    fd, path = tempfile.mkstemp(prefix="echoline-", suffix=".zip")
    os.close(fd)
    atexit.register(lambda: Path(path).unlink(missing_ok=True))  # executors fetch it from here as long as the driver lives
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(ROOT.joinpath("echoline").rglob("*.py")):
            archive.write(source, source.relative_to(ROOT).as_posix())
    context.addPyFile(path)
    _shipped.add(context.applicationId)
