"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build(app: str = "chainmetrics", **more: str) -> SparkSession:
    """A session with the settings that all jobs expect; more: further settings, dots written as __."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    for key, value in more.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors' Python workers, once a session's context."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "chainmetrics.zip")
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, path.relative_to(root.parent))
        context.addPyFile(target)
        _shipped.add(context.applicationId)
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder for a job's intermediate files: in the folder that the cluster shares, or a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base.rstrip('/')}/job-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="spark-", dir="/tmp")
