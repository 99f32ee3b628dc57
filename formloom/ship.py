"""Making the package importable in Python workers that do not share the driver's path."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per application, unless PYTHONPATH already has it."""
    context = spark.sparkContext
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if ROOT in paths or Path.cwd().resolve() == ROOT or context.applicationId in _DONE:
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/formloom", "zip", ROOT, "formloom")  # the driver serves this file for the session
    context.addPyFile(archive)
    if str(ROOT) not in sys.path:
        sys.path.insert(0, str(ROOT))
    _DONE.add(context.applicationId)
