"""What Python workers need to run this package's functions."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch at most where a session sets none: they bound what a Python worker holds at a time (one row at least).
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and keep what they are sent small."""
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for files that all executors must see: below ``spark.checkpoint.dir``.

    Only a local master may do without that setting.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="placelink-")
    return f"{found.rstrip('/')}/placelink/{name}-{uuid.uuid4().hex}"
