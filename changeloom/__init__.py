"""Change-set analytics and corpus preparation on Spark."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context; they needn't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_changeloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="changeloom-")) / "changeloom.zip"  # the driver serves it from here
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    sc._changeloom_shipped = True
