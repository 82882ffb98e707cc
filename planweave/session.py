"""Session settings and the package's way to the workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "planweave", master: str | None = None, **more) -> SparkSession:
    """A session with adaptive execution and UTC; ``more`` settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in more.items()}}.items():
        builder = builder.config(k, v)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import the package: by its path where they run on this machine, on a
    cluster by an archive that Spark hands to every executor, once an application."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # times without a zone are read as UTC throughout
    package = Path(__file__).resolve().parent
    home = str(package.parent)
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        if sc.applicationId not in _SHIPPED:
            _SHIPPED.add(sc.applicationId)
            archive = Path(tempfile.mkdtemp(prefix="planweave-")) / "planweave.zip"
            with zipfile.ZipFile(archive, "w") as z:
                for f in sorted(package.rglob("*.py")):
                    z.write(f, f.relative_to(package.parent))
            sc.addPyFile(str(archive))
        return spark
    env = sc.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])
    return spark


_SHIPPED: set[str] = set()
