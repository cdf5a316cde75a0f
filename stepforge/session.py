"""Session helpers: settings the engine relies on and shipping the package to executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


#: Small Arrow batches, since texts are long: rows and bytes a batch, unless the session sets its own.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers; once a SparkContext."""
    for key, value in ARROW_BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if getattr(context, "_stepforge_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as staging:
        shutil.copytree(os.path.join(root, "stepforge"), os.path.join(staging, "src", "stepforge"), ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "stepforge"), "zip", os.path.join(staging, "src")))
    context._stepforge_shipped = True
