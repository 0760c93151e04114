"""Getting the package to the executors' Python."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per session, so that their Python finds it
    wherever the driver's was imported from."""
    sc = spark.sparkContext
    if getattr(sc, "_strataweave_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if not root.is_dir():  # imported from an archive: it is on the path already
        sc._strataweave_shipped = True
        return
    out = Path(tempfile.mkdtemp(prefix="strataweave-")) / "strataweave.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    sc.addPyFile(str(out))
    sc._strataweave_shipped = True
