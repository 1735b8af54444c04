"""Session settings that the package's plans assume, and the package itself for the workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, which import it by name wherever the driver was started."""
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="tidemark-", suffix=".zip")
    os.close(handle)
    atexit.register(Path(path).unlink, missing_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)


def build_session(app: str = "tidemark", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the package's settings; ``extra`` overrides them (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = SETTINGS | {k.replace("__", "."): v for k, v in extra.items()}
    spark = builder.config(map=settings).getOrCreate()
    ship(spark)
    return spark
