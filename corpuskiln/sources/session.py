"""Making the package known to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, unless their Python finds it by itself."""
    sc = spark.sparkContext
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in paths or os.getcwd() == str(ROOT) or getattr(sc, "_corpuskiln_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="corpuskiln-")) / "corpuskiln.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((ROOT / "corpuskiln").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(out))
    sc._corpuskiln_shipped = True
