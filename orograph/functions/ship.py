"""Make the package importable on executors, whatever started the session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_shipped: set[str] = set()
#: Rows of long texts go to Python in batches of at most this size, unless the session says otherwise.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def ship(spark: SparkSession) -> None:
    """Send the package's sources (some hundred KB) to the executors, once per application."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    fd, path = tempfile.mkstemp(prefix="orograph-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, dirs, names in os.walk(os.path.join(_ROOT, "orograph")):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
