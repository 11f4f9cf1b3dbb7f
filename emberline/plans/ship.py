"""Getting this package to the Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import weakref
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors of the session's context, once.

    Workers then import it wherever the driver was started and whatever their own path is."""
    sc = spark.sparkContext
    if sc in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="emberline-code-")
    atexit.register(shutil.rmtree, folder, True)  # executors fetch the archive as long as the context lives
    try:
        stage = os.path.join(folder, "stage")
        shutil.copytree(root, os.path.join(stage, root.name), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "emberline_code"), "zip", stage))
    finally:
        shutil.rmtree(os.path.join(folder, "stage"), ignore_errors=True)
    _SHIPPED.add(sc)
