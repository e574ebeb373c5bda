"""Sends the package to Python workers that could not import it otherwise."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a Python file of the session, once, unless workers find it by PYTHONPATH or in the working folder."""
    sc = spark.sparkContext
    found = [os.path.realpath(p or ".") for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), "."]]
    if str(ROOT) in found or sc.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp()  # the driver's own: Spark sends the file to the workers from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / "huelake.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted([*ROOT.glob("huelake/**/*.py"), *ROOT.glob("corpus_pipeline.py")]):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)
