"""Make this package importable in Python workers that don't start in its folder."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once per application, unless they find it anyway."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == ROOT:
        return
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    base = Path(tempfile.mkdtemp(prefix="tidefold-ship-"))
    shutil.copytree(ROOT / "tidefold", base / "src" / "tidefold", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(base / "tidefold"), "zip", base / "src"))
    _SENT.add(app)
