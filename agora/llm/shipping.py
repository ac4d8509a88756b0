"""Sending this package to the executors, where it need not be installed."""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

import agora

_sent: set[str] = set()

# Spark's own bound of an Arrow batch is 64 MB, and it holds a batch in buffers that
# double as they grow, for each task, beside the heap.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session; a smaller bound of its own stays."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(_BATCH).strip().lower()).groups()
    said = int(number) << 10 * "kmgtp".find(unit) + 10 if unit else int(number)
    if not 0 < said <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once; Spark serves them.

    Batches of rows for Python are bounded in this session as well, so that long texts
    do not pile up in the executors.
    """
    _small_batches(spark)
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(agora.__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="agora-py-"), "agora_py"), "zip", root, "agora")
    context.addPyFile(archive)
    _sent.add(context.applicationId)
