"""The package's own code on the executors."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Arrow batches that go to Python hold at most this much, however long the texts; Spark's default is 64 MB.
BATCH_BYTES = "16m"


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once for each application, wherever they run, and bounds
    the batches that reach it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="code-"), "ruleforge.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("ruleforge", os.path.relpath(full, root)))
    sc.addPyFile(path)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    _shipped.add(sc.applicationId)


def shipped(query: Callable) -> Callable:
    """query(spark, ...), after ship(spark)."""

    @functools.wraps(query)
    def run(spark: SparkSession, *rest):
        ship(spark)
        return query(spark, *rest)

    return run
