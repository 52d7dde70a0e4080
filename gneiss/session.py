"""Sessions, and the package on their executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application. A cluster that has it
    installed loses nothing; one that hasn't can still load the Python workers' functions."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    into = tempfile.mkdtemp(prefix="gneiss-ship-")
    package = shutil.copytree(here, os.path.join(into, "tree", os.path.basename(here)), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(into, "gneiss"), "zip", os.path.dirname(package)))
    _shipped.add(app)


def session(cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that the engine is tested with."""
    n = cores or os.cpu_count() or 1
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        # Larger generated methods aren't compiled by the JVM; below this limit they are cut up.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
