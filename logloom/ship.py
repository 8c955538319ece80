"""Make the package importable in the Python workers of a local session that was started without it.

On a cluster the package is given to the executors with ``--py-files`` or installed there.
"""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once for each application, as ``--py-files`` would."""
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if app in _shipped or not (master == "local" or master.startswith("local[")):
        return
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    shutil.copytree(Path(__file__).parent, folder / "package" / "logloom", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(folder / "logloom"), "zip", folder / "package"))
    _shipped.add(app)
