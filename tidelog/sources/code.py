"""Ships this package to Python workers, wherever the driver imported it from."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once per context."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_tidelog_shipped", False) or not root.is_dir():
        return
    folder = Path(tempfile.mkdtemp())
    path = folder / f"{root.name}_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(str(path))  # executors fetch it from there, so it stays until the driver ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context._tidelog_shipped = True
