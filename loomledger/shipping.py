"""Make this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers, unless their PYTHONPATH (the driver's) has it."""
    context = spark.sparkContext
    roots = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if getattr(context, "_loom_shipped", False) or any(x and Path(x).resolve() == _PACKAGE.parent for x in roots):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="loomledger-src-"), "loomledger.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    context.addPyFile(target)
    context._loom_shipped = True
