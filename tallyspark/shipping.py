"""Makes this package importable in Python workers, wherever they run, with batches they can hold."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows and bytes of an Arrow batch, Spark's defaults and ours, unless the session says otherwise:
#: whole texts are wide, and 10,000 of them would take a lot of each Python worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "512"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "2m")}


def ship(spark: SparkSession) -> None:
    """Once per application, hand a zip of the package to Spark, which serves it to executors."""
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, ours)
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if sc.applicationId in _shipped or not os.path.isdir(root):
        return
    _shipped.add(sc.applicationId)
    path = os.path.join(tempfile.mkdtemp(prefix="tallyspark-zip-"), "tallyspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("tallyspark", os.path.relpath(full, root)))
    sc.addPyFile(path)
