"""Cutting lineage, and the package for workers."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder in spark.checkpoint.dir (a temporary one where that is unset and all runs on this machine, as in tests)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers once per application, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
