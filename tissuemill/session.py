"""Sessions, and the package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def get_session(app: str = "tissuemill", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context; the driver serves the archive."""
    context = spark.sparkContext
    if getattr(context, "_tissuemill_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "tissuemill_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(HERE.rglob("*.py")):
            out.write(path, Path("tissuemill") / path.relative_to(HERE))
    context.addPyFile(str(archive))
    context._tissuemill_shipped = True
