"""Session factory: ANSI, UTC and adaptive execution; sizes stay with the cluster's own settings."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that results or plans rely on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(name: str = "sparkloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Sends this package to the Python workers, once a Spark application, so that executors need no copy of it.  Every
    operator that runs Python functions calls it; without a session the active one counts."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sparkloom-")
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder) / "sparkloom_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(spark.sparkContext.applicationId)
