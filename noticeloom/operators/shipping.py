"""Makes the package importable in Python workers, wherever the session was started from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Adds a zip of this package to the application once; executors fetch it from the driver.

    Rows may be whole documents, so the default of 10,000 rows in an Arrow batch is lowered unless it has been changed.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "2000")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        path = Path(tempfile.mkdtemp(prefix="package-")) / f"{_PACKAGE.name}.zip"
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(_PACKAGE.rglob("*.py")):
                out.write(file, file.relative_to(_PACKAGE.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped[app] = str(path)
