"""Sending this package to the executors, for a session that wasn't started with it on its path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="pagewright-")  # on the driver, which serves the file as long as it runs
    atexit.register(shutil.rmtree, folder, True)
    path = Path(folder) / "pagewright.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "pagewright").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(path))
    _SENT.add(sc.applicationId)
