"""Sending this package to the executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip once per application: workers need not have the driver's path, local ones neither."""
    sc = spark.sparkContext
    if getattr(sc, "_halyard_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = os.path.join(tempfile.mkdtemp(prefix="halyard-"), f"{root.name}.zip")
    Path(path).write_bytes(buffer.getvalue())
    sc.addPyFile(path)
    sc._halyard_shipped = True
