"""Makes the package importable on every executor."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package's sources to the executors once per application, for their Python workers."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for path in sorted(ROOT.rglob("*.py")):
            archive.write(path, path.relative_to(ROOT.parent))
    folder = Path(tempfile.mkdtemp(prefix="package-"))
    (folder / "tracelake_package.zip").write_bytes(buffer.getvalue())
    sc.addPyFile(str(folder / "tracelake_package.zip"))
    _shipped.add(sc.applicationId)
