"""The package on executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of a cluster, once per application; executors of a local session are the driver itself."""
    context = spark.sparkContext
    local = context.master.startswith("local") and not context.master.startswith("local-cluster")
    if local or context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="eventlake-package-")  # on the driver, which serves it to executors while it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(str(Path(folder) / "eventlake"), "zip", root, "eventlake"))
    _shipped.add(context.applicationId)
